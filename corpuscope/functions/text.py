"""Text helpers. Every function takes and returns a Column; none needs a UDF."""
from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from ..rules.packs import ACRONYMS

URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"  # the URL namespace of RFC 4122


def sql_text(value: str) -> str:
    """A Spark SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lit_array(values) -> Column:
    """Array literal, made as one expression."""
    items = [sql_text(v) if isinstance(v, str) else str(v) for v in values]
    return F.expr(f"array({', '.join(items)})" if items else "cast(array() as array<string>)")


def contains_any(text: Column, words) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return out


def _alternatives(regex: str) -> list[str]:
    """Top-level alternatives of a pattern (those not inside brackets)."""
    out, depth, cur, skip = [], 0, "", False
    for ch in regex:
        if skip or ch == "\\":
            cur, skip = cur + ch, not skip
            continue
        depth += ch in "([{"
        depth -= ch in ")]}"
        if ch == "|" and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return out + [cur]


def occurs(regex: str, content: str = "content", lowered: str = "lowered") -> str:
    """SQL condition that ``regex`` occurs in a text column, with cheap tests first.

    Alternatives of an ignore-case pattern that are plain text become ``contains`` on the
    lower-case text, a byte search. Others run as regexes, behind the plain text they start
    with if there is any. The answer is that of the regex itself.
    """
    if not regex.startswith("(?i)"):
        return f"{content} rlike {sql_text(regex)}"
    tests = []
    for alt in _alternatives(regex[4:]):
        plain = re.match(r"(?:[A-Za-z0-9_ :/@=,;-]|\\[.()/*+?-])*", alt).group(0)
        if plain != alt and alt[len(plain):][:1] in ("*", "?", "{", "+"):  # the last character may be absent
            plain = re.sub(r"\\?.$", "", plain)
        bare = re.sub(r"\\(.)", r"\1", plain).lower()
        if plain == alt:
            tests.append(f"contains({lowered}, {sql_text(bare)})")
        else:
            test = f"{content} rlike {sql_text('(?i)' + alt)}"
            tests.append(f"(contains({lowered}, {sql_text(bare)}) and {test})" if len(bare) >= 2 else f"({test})")
    return "(" + " or ".join(tests) + ")"


def snake(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def module_snake(name: Column) -> Column:
    """Snake form of a module name: leading dots go, an empty result becomes ``unnamed``."""
    out = snake(F.regexp_replace(name, r"^\.+", ""))
    return F.when(out == "", "unnamed").otherwise(out)


def feature_key(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def capitalize(word: Column) -> Column:
    return F.concat(F.upper(F.left(word, F.lit(1))), F.lower(F.substr(word, F.lit(2))))


def title(text: Column) -> Column:
    """Upper case after every non-letter, lower case elsewhere (``k8s`` -> ``K8S``)."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}])"), F.lit(1))
    return F.array_join(F.transform(runs, capitalize), "")


def display(name: Column) -> Column:
    return title(F.replace(name, F.lit("_"), F.lit(" ")))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def humanize(name: Column) -> Column:
    return F.array_join(F.transform(words(F.replace(name, F.lit("_"), F.lit(" "))), capitalize), " ")


def title_with_acronyms(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ACRONYMS.items() for x in pair])

    def one(token):
        slash = token.startswith("/")
        bare = F.regexp_replace(token, "^/", "")
        return F.concat(F.when(slash, "/").otherwise(""),
                        F.coalesce(F.try_element_at(table, F.upper(bare)), capitalize(bare)))

    tokens = F.split(F.replace(name, F.lit("ci_cd"), F.lit("ci_/cd")), "_")
    return F.replace(F.array_join(F.transform(tokens, one), " "), F.lit(" /"), F.lit("/"))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def trim_to_words(text: Column, n: int) -> Column:
    """At most ``n`` words, cut after the last full sentence, else after the last word."""
    head = F.array_join(F.slice(words(text), 1, n), " ")
    sentence = F.regexp_extract(head, r"(?s)^(.+\.) ", 1)
    hard = F.concat(F.regexp_replace(head, "[,;:]+$", ""), F.lit("."))
    return F.when(word_count(text) <= n, text).when(sentence != "", sentence).otherwise(hard)


def clean_dep_name(raw: Column) -> Column:
    return F.regexp_replace(raw, r"""^[\s"']+|[\s"']+$""", "")


def top_docstring(content: Column, limit: int | None = None) -> Column:
    """Docstring or leading comment of a source text, whole unless ``limit`` characters are asked for."""
    cut = (lambda c: c) if limit is None else (lambda c: F.substring(c, 1, limit))

    def found(pattern):
        text = F.regexp_extract(content, pattern, 1)
        return F.when(content.rlike(pattern), cut(F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))))

    comment = F.filter(F.slice(F.split(content, "\n"), 1, 10), lambda x: F.trim(x).rlike("^[/#*]"))
    comment = F.transform(comment, lambda x: F.trim(F.regexp_replace(x, "^[/ #*]+", "")))
    return F.coalesce(found(r'(?s)^\s*"""(.*?)"""'), found(r"(?s)^\s*'''(.*?)'''"),
                      found(r"(?s)/\*\*(.*?)\*/"), cut(F.array_join(comment, " ")))


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    part = lambda start, n: F.substring(digest, start, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"),
                    variant, part(18, 3), F.lit("-"), part(21, 12))


def md5_fingerprint(text: Column, n: int = 8) -> Column:
    return F.substring(F.md5(text), 1, n)


def percent(conf: Column) -> Column:
    return F.concat(F.round(conf * 100).cast("int").cast("string"), F.lit("%"))


def hundredths(conf: Column) -> Column:
    return F.round(conf * 100).cast("int")


def numbered(prefix: str, n: Column, width: int = 0) -> Column:
    """``FR-7`` or, with a width, ``feat-007``; longer numbers keep all their digits."""
    digits = n.cast("string")
    if width:
        digits = F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)
    return F.concat(F.lit(prefix), digits)


def glob_regex(pattern: str) -> str:
    """Regex of a file glob: ``*`` also crosses ``/``, ``**/`` may stand for nothing."""
    anywhere = pattern.startswith("**/")
    body = pattern[3:] if anywhere else pattern
    out = ""
    for ch in body.lower():
        out += {"*": ".*", "?": "."}.get(ch) or ("\\" + ch if ch in r"\.+^$(){}|[]" else ch)
    return "^" + ("(.*/)?" if anywhere else "") + out + "$"
