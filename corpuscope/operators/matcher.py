"""Many rules over many texts in one scan: tagged matches by a shared search for anchors.

Every match of a regex contains one of a few plain texts that can be read off the pattern, its
anchors. The anchors of all rules go into one automaton; it runs once over the lower-case text of
a file and names the rules that can match there, usually none, and only those run. A file leaves
one array of tagged matches, from which every family of signals reads its own.

Patterns are those of the rule tables: ``\\w``, ``\\b``, ``\\s`` and ``(?i)`` are ASCII.
"""
from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .names import PIECE_ROWS

try:  # the pattern's own parse tree; the name is newer than Python 3.10
    from re import _parser as _tree
except ImportError:
    import sre_parse as _tree


class Search(NamedTuple):
    """What to look for in the files where the flag column ``where`` holds.

    ``groups`` 0 notes that the regex occurs, 1 or 2 gives a row per match with so many groups,
    and -1 counts the matches.
    """
    family: str
    signal: str
    regex: str
    where: str
    exts: tuple = ()
    groups: int = 0


#: One tagged match: its place in the order of searches and matches, and its groups; ``n`` is 1 or the count.
HIT = "struct<family:string,signal:string,search:int,n:int,one:string,two:string>"


def anchors(regex: str) -> list[str] | None:
    """Lower-case texts of which every match contains one (its own lower-case form), or None."""

    def of(items) -> list[str] | None:
        found: list[list[str]] = []
        run = ""
        for op, value in [*items, (None, None)]:
            name = str(op)
            if name == "LITERAL" and chr(value).isascii():
                run += chr(value).lower()
                continue
            if run:
                found.append([run])
                run = ""
            inner = None
            if name == "SUBPATTERN":
                inner = of(value[3])
            elif name == "BRANCH":
                each = [of(b) for b in value[1]]
                inner = None if any(e is None for e in each) else [x for e in each for x in e]
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
                inner = of(value[2])
            if inner:
                found.append(inner)
        return max(found, key=lambda f: (min(map(len, f)), -len(f))) if found else None

    return of(_tree.parse(regex, re.ASCII))


def tagged_matches(df: DataFrame, searches: list[Search], keep=("repo", "path", "ext")) -> DataFrame:
    """(keep, hits) of every file with a match; ``df`` has content, ext and the flag columns of the searches.

    The searches of a file's ``where`` flags and extensions run in their order, so hits are in
    the order of searches, then of matches.
    """
    flags = sorted({s.where for s in searches})
    plain = [tuple(s) for s in searches]
    known = [anchors(s.regex) for s in searches]
    n_kept = len(keep)
    at_ext = list(keep).index("ext")

    def part(batches):
        import re as regexes

        import pyarrow as pa
        compiled = [regexes.compile(s[2], regexes.ASCII) for s in plain]
        always = [i for i, a in enumerate(known) if not a]
        by_anchor: dict[str, list[int]] = {}
        for i, texts in enumerate(known):
            for a in texts or ():
                by_anchor.setdefault(a, []).append(i)
        try:
            import ahocorasick
            automaton = ahocorasick.Automaton()
            for a, owners in by_anchor.items():
                automaton.add_word(a, a)
            if by_anchor:
                automaton.make_automaton()
            told = (lambda t: {a for _, a in automaton.iter(t)}) if by_anchor else (lambda t: ())
        except ImportError:  # the same answer, one search for each anchor
            told = lambda t: [a for a in by_anchor if a in t]
        hit = pa.struct([("family", pa.string()), ("signal", pa.string()), ("search", pa.int32()), ("n", pa.int32()), ("one", pa.string()), ("two", pa.string())])

        def found(text, ext, on):
            may = sorted({*always, *(i for a in told(text.lower()) for i in by_anchor[a])})
            out = []
            for i in may:
                family, signal, _, where, exts, groups = plain[i]
                if where not in on or (exts and ext not in exts):
                    continue
                if groups == 0:
                    if compiled[i].search(text):
                        out.append((family, signal, i, 1, None, None))
                elif groups < 0:
                    n = sum(1 for _ in compiled[i].finditer(text))
                    if n:
                        out.append((family, signal, i, n, None, None))
                else:
                    out += [(family, signal, i, 1, m.group(1), m.group(2) if groups > 1 else None) for m in compiled[i].finditer(text)]
            return out

        names = [f.name for f in hit]
        for b in batches:
            for at in range(0, b.num_rows, PIECE_ROWS):
                piece = b.slice(at, PIECE_ROWS)
                exts = piece.column(at_ext).to_pylist()
                on = zip(*(piece.column(n_kept + k).to_pylist() for k in range(len(flags))))
                texts = piece.column(n_kept + len(flags)).to_pylist()
                rows, lists = [], []
                for i, (text, ext, marks) in enumerate(zip(texts, exts, on)):
                    hits = found(text, ext, {f for f, m in zip(flags, marks) if m}) if text else []
                    if hits:
                        rows.append(i)
                        lists.append([dict(zip(names, h)) for h in hits])
                if rows:
                    chosen = pa.array(rows, pa.int64())
                    yield pa.RecordBatch.from_arrays([*(c.take(chosen) for c in piece.columns[:n_kept]), pa.array(lists, pa.list_(hit))],
                                                     names=[*b.schema.names[:n_kept], "hits"])
            b = piece = None  # else they stay while the next batch is read

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keep) + f", hits array<{HIT}>"
    return df.select(*keep, *flags, "content").mapInArrow(part, schema)


def hits_of(tagged: DataFrame, *families: str) -> DataFrame:
    """(repo, path, ext, at, family, signal, search, n, one, two) of the matches of some families; ``at`` orders a file's."""
    wanted: Column = F.filter(F.transform("hits", lambda h, i: F.struct(i.alias("at"), h.alias("h"))), lambda x: x["h"]["family"].isin(*families))
    return tagged.select("repo", "path", "ext", F.explode(wanted).alias("x")).select("repo", "path", "ext", "x.at", "x.h.*")
