"""Names in texts, without pairing texts and names.

All names go into one automaton, which reads each text once in its row and leaves the distinct
names that occur in it; only these short rows meet the table the names come from, by equi join. A
table of names too large for one automaton is dealt into blocks, each with its own reading of
the texts, so what a task holds is bounded however many names there are.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..session import hold

#: Bytes of names in one automaton; it takes some hundred times that in memory.
BLOCK_BYTES = 1 << 20
#: Rows of a batch that a task has as Python objects at a time.
PIECE_ROWS = 128
#: Parts of a key that may hold many rows.
SALTS = 16


def name_blocks(names: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """The distinct non-empty values of ``name`` in tables of about ``block_bytes`` each."""
    distinct = names.select("name").filter("name <> ''").distinct()
    total = distinct.agg(F.coalesce(F.sum(F.octet_length("name")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    if n == 1:
        return [distinct]
    held = hold(distinct)
    return [held.filter(F.pmod(F.xxhash64("name"), F.lit(n)) == i) for i in range(n)]


def _matched(docs: DataFrame, block: DataFrame, text: str, out: str) -> DataFrame:
    words = sorted(r["name"] for r in block.collect())  # bounded by name_blocks
    shared = docs.sparkSession.sparkContext.broadcast(words)
    kept = [f for f in docs.schema.fields if f.name != text]

    def part(batches):
        import pyarrow as pa
        words = shared.value
        try:
            import ahocorasick
            automaton = ahocorasick.Automaton()
            for i, w in enumerate(words):
                automaton.add_word(w, i)
            if words:
                automaton.make_automaton()
            find = (lambda t: {i for _, i in automaton.iter(t)}) if words else (lambda t: ())
        except ImportError:  # the same result, one search for each name
            find = lambda t: [i for i, w in enumerate(words) if w in t]
        values = pa.array(words, pa.string())
        for b in batches:
            for at in range(0, b.num_rows, PIECE_ROWS):
                piece = b.slice(at, PIECE_ROWS)
                found = [sorted(find(t)) if t else [] for t in piece.column(0).to_pylist()]
                ends = [0]
                for f in found:
                    ends.append(ends[-1] + len(f))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values.take(pa.array([i for f in found for i in f], pa.int64())))
                yield pa.RecordBatch.from_arrays([*piece.columns[1:], lists], names=[*b.schema.names[1:], out])
            b = piece = None  # else they stay while the next batch is read

    schema = T.StructType([*kept, T.StructField(out, T.ArrayType(T.StringType()))])
    return docs.select(text, *[f.name for f in kept]).mapInArrow(part, schema)


def with_names(docs: DataFrame, names: DataFrame, text: str = "text", out: str = "names", key: str | list[str] = "doc_key", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without their text, but with the array of the names that occur in it.

    ``names`` has a column ``name``. A null text holds no name. ``key`` names the columns that
    identify a document; they are used only where the names need several readings.
    """
    keys = [key] if isinstance(key, str) else key
    first, *more = name_blocks(names, block_bytes)
    found = _matched(docs, first, text, out)
    if not more:
        return found
    others = None
    for block in more:
        hits = hold(_matched(docs.select(*keys, text), block, text, "_more_names").filter(F.size("_more_names") > 0))
        others = hits if others is None else others.unionByName(hits)
    lists = others.groupBy(*keys).agg(F.flatten(F.collect_list("_more_names")).alias("_more_names"))  # one row for each block
    return found.join(lists, keys, "left").withColumn(out, F.concat(out, F.coalesce("_more_names", F.array().cast("array<string>")))).drop("_more_names")


def salted_join(rows: DataFrame, table: DataFrame, on: list[str], key: str = "doc_key", how: str = "inner") -> DataFrame:
    """Equi join of many rows with a smaller table, when one value of ``on`` may have a third of the rows.

    The rows of a value are dealt by ``key``, and the table is there once for every part.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    right = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")
