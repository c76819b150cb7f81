"""The query language: what a user types becomes alternatives of terms, then Spark conditions on lines.

Words are joined by an implicit AND in any order, ``OR`` or ``|`` part alternatives, AND binds tighter, a phrase in double quotes is one
term. ``/body/flags`` is a regular expression. All terms of an alternative have to be on one line.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EmptyPattern, InvalidPattern

#: Characters with a meaning in a regular expression.
META = r"\.+*?()|[]{}^$#"


@dataclass(frozen=True)
class Flags:
    ignore_case: bool = False
    word: bool = False
    fixed: bool = False
    multi_line: bool = False
    dot_all: bool = False
    extended: bool = False


@dataclass(frozen=True)
class Query:
    """kind: human, literal or regex. A human query or a literal has alternatives; a regular expression has a body."""

    kind: str
    flags: Flags
    alternatives: tuple[tuple[str, ...], ...] = ()
    body: str = ""
    source: str = field(default="", compare=False)


def escape(text: str) -> str:
    return "".join("\\" + c if c in META else c for c in text)


def compile_query(pattern: str, flags: Flags | None = None) -> Query:
    """Raises EmptyPattern or InvalidPattern; nothing is read before."""
    flags, text = flags or Flags(), pattern.strip()
    if not text:
        raise EmptyPattern
    if flags.fixed:
        return Query("literal", flags, ((text,),), source=text)
    if (slash := re.fullmatch(r"(?s)/(.*)/([a-z]*)", text)) is not None:
        return _regex(slash[1], slash[2], flags, text)
    return Query("human", flags, _alternatives(_tokens(text)), source=text)


def raw_query(pattern: str, flags: Flags | None = None) -> Query:
    """A regular expression as it is, not trimmed and not read as words."""
    if not pattern:
        raise EmptyPattern
    return Query("regex", flags or Flags(), body=_dialect(pattern), source=pattern)


def _regex(body: str, letters: str, flags: Flags, source: str) -> Query:
    if not body:
        raise EmptyPattern
    known = {"i": "ignore_case", "m": "multi_line", "s": "dot_all", "x": "extended"}
    for c in letters:
        if c in known:
            flags = replace(flags, **{known[c]: True})
        elif c != "g":
            raise InvalidPattern(f"unknown regex flag '{c}'; known flags are i, g, m, s and x")
    return Query("regex", flags, body=_dialect(body), source=source)


def _dialect(body: str) -> str:
    """Named groups and POSIX classes as Java has them; what Java lacks is refused by name."""
    body = re.sub(r"\(\?P<", "(?<", body)
    body = re.sub(r"\[:(\^?)(alpha|digit|alnum|upper|lower|punct|space|xdigit|cntrl|print|graph|blank):\]", lambda m: ("\\P{" if m[1] else "\\p{") + {"xdigit": "XDigit"}.get(m[2], m[2].capitalize()) + "}", body)
    for bad, what in ((r"\(\?R\)", "recursion"), (r"(?<!\\)\\K", "\\K"), (r"\(\*[A-Z]", "control verbs"), (r"\(\?\|", "branch reset"), (r"\(\?\(", "conditions")):
        if re.search(bad, body):
            raise InvalidPattern(f"{what} isn't supported in a pattern")
    return body


def _tokens(text: str) -> list[tuple[str, str]]:
    """(kind, text) with kinds term, and, or."""
    out, at = [], 0
    while at < len(text):
        if text[at].isspace():
            at += 1
        elif text[at] == '"':
            end = text.find('"', at + 1)
            if end < 0:
                raise InvalidPattern("unclosed quote")
            if end == at + 1:
                raise InvalidPattern("empty quoted phrase")
            out.append(("term", text[at + 1 : end]))
            at = end + 1
        else:
            end = at
            while end < len(text) and not text[end].isspace():
                end += 1
            word, at = text[at:end], end
            if word in ("AND", "OR"):
                out.append((word.lower(), word))
            else:
                for k, part in enumerate(word.split("|")):
                    if k:
                        out.append(("or", "|"))
                    if part:
                        out.append(("term", part))
    return out


def _alternatives(tokens: list[tuple[str, str]]) -> tuple[tuple[str, ...], ...]:
    groups: list[list[tuple[str, str]]] = [[]]
    for kind, text in tokens:
        if kind == "or":
            groups.append([])
        else:
            groups[-1].append((kind, text))
    out = []
    for g in groups:
        if not g:
            raise InvalidPattern("empty alternative: OR needs a term on both sides")
        kinds = [k for k, _ in g]
        if kinds[0] == "and" or kinds[-1] == "and" or any(a == b == "and" for a, b in zip(kinds, kinds[1:], strict=False)):
            raise InvalidPattern("AND needs a term on both sides")
        out.append(tuple(t for k, t in g if k == "term"))
    return tuple(out)


# ---------------------------------------------------------------- Spark


def _inline(flags: Flags) -> str:
    return "(?dU" + "iu" * flags.ignore_case + "m" * flags.multi_line + "s" * flags.dot_all + "x" * flags.extended + ")"


def term_pattern(term: str, flags: Flags) -> str:
    """A term as a Java pattern."""
    own = escape(term)
    return _inline(replace(flags, extended=False)) + (rf"(?<!\w)(?:{own})(?!\w)" if flags.word else own)


def regex_pattern(q: Query) -> str:
    return _inline(q.flags) + (rf"(?<!\w)(?:{q.body})(?!\w)" if q.flags.word else q.body)


def plain(q: Query) -> bool:
    """Whether terms are found by substring search."""
    return q.kind != "regex" and not q.flags.ignore_case and not q.flags.word


def check_java(spark, q: Query) -> Query:
    """Compiles the pattern once on the driver: Spark itself would find a bad one only in a task."""
    if q.kind == "regex":
        try:
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(regex_pattern(q))
        except Exception as e:
            raise InvalidPattern(str(getattr(e, "java_exception", e)).splitlines()[0]) from None
    return q


def _term(line: Column, term: str, q: Query) -> Column:
    return line.contains(term) if plain(q) else line.rlike(term_pattern(term, q.flags))


def line_matches(line: Column, q: Query) -> Column:
    if q.kind == "regex":
        return line.rlike(regex_pattern(q))
    out = None
    for alt in q.alternatives:
        both = None
        for t in alt:
            both = _term(line, t, q) if both is None else both & _term(line, t, q)
        out = both if out is None else out | both
    return out


def matches(text: Column, q: Query) -> Column:
    """The condition on a whole text. Substrings of the text are tested first where that is sound, and reach the scan."""
    if q.kind != "regex" and all(len(a) == 1 and "\n" not in a[0] for a in q.alternatives) and plain(q):
        return line_matches(text, q)
    on_a_line = F.exists(F.split(text, "\n"), lambda line: line_matches(line, q))
    if q.kind != "regex" and not q.flags.ignore_case:
        pre = None
        for alt in q.alternatives:
            both = None
            for t in alt:
                both = text.contains(t) if both is None else both & text.contains(t)
            pre = both if pre is None else pre | both
        return pre & on_a_line
    return on_a_line


def _place(line: Column, pattern: str | None, term: str) -> Column:
    """struct(pos, len) in bytes of the leftmost match in a line; null without one."""
    if pattern is None:
        at = F.locate(term, line)
        pos, size = F.octet_length(F.substring(line, F.lit(1), at - 1)), F.lit(len(term.encode()))
    else:
        at = F.regexp_instr(line, F.lit(pattern))  # counts UTF-16 units
        units = F.substring(F.encode(line, "UTF-16BE"), F.lit(1), (at - 1) * 2)
        pos, size = F.octet_length(F.decode(units, "UTF-16BE")), F.octet_length(F.coalesce(F.regexp_substr(line, F.lit(pattern)), F.lit("")))
    return F.when(at > 0, F.struct(pos.cast("long").alias("pos"), (-size).cast("long").alias("neg")))


def first_match(text: Column, q: Query) -> Column:
    """struct(pos, len) in bytes of the first match in a text; of matches at one place the longest. Null without one.

    An alternative of several terms matches at the start of its line, with no length.
    """

    def in_line(line: Column) -> Column:
        if q.kind == "regex":
            found = [_place(line, regex_pattern(q), "")]
        else:
            found = []
            for alt in q.alternatives:
                if len(alt) == 1:
                    found.append(_place(line, None if plain(q) else term_pattern(alt[0], q.flags), alt[0]))
                else:
                    all_there = line_matches(line, replace(q, alternatives=(alt,)))
                    found.append(F.when(all_there, F.struct(F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"))))
        return F.array_min(F.array(*found)) if len(found) > 1 else found[0]

    lines = F.split(text, "\n")
    no = F.array_position(F.transform(lines, lambda x: line_matches(x, q)), True).cast("int")
    before = F.aggregate(F.slice(lines, F.lit(1), F.greatest(no - 1, F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 1)
    hit = F.transform(F.array(F.get(lines, no - 1)), in_line)[0]
    return F.when(no > 0, F.struct((before + hit["pos"]).alias("pos"), (-hit["neg"]).alias("len")))


def match_count(text: Column, q: Query) -> Column:
    """Matches in all lines, of queries whose alternatives have one term each."""
    pattern = regex_pattern(q) if q.kind == "regex" else "|".join(f"(?:{term_pattern(a[0], q.flags)})" for a in q.alternatives)
    return F.aggregate(F.split(text, "\n"), F.lit(0).cast("long"), lambda a, x: a + F.regexp_count(x, F.lit(pattern)))
