"""Training-data operators: filters, deduplication, scoring and packing of documents.

Functions of this subpackage that run in tasks are sent to the executors with their code, so the
package need not be installed there.
"""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
