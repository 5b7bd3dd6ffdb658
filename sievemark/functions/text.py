"""Text primitives as Columns: phrase hits, spans with byte offsets, words, entropy, checksums.

Offsets and lengths of spans count UTF-8 bytes. `\\b` of a pattern is ASCII here: ASCII look-arounds replace it,
so that results do not depend on a regex engine's view of accented letters.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<entity_type:string,text:string,start:int,end:int,confidence:double>"
SPANS = f"array<{SPAN}>"
FACTORS = "array<struct<factor_type:string,description:string,severity:string,score_contribution:double>>"
#: Severities from low to high.
SEVERITIES = ("none", "low", "medium", "high", "critical")


def strings(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def pairs(values) -> Column:
    """An array of (p, c) from phrases with confidences, in their order."""
    return F.array(*(F.struct(F.lit(p).alias("p"), F.lit(float(c)).alias("c")) for p, c in values))


def let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hits(lowered: Column, phrases) -> Column:
    """Phrases that are in the lower-case text, in the order of the list. The text is bound: an expression in a lambda would be computed for each phrase."""
    return let(lowered, lambda low: F.filter(strings(phrases), lambda p: F.contains(low, p)))


def scored_hits(lowered: Column, phrases) -> Column:
    return let(lowered, lambda low: F.filter(pairs(phrases), lambda x: F.contains(low, x["p"])))


def has_any(lowered: Column, phrases) -> Column:
    return let(lowered, lambda low: reduce(lambda found, p: found | F.contains(low, F.lit(p)), phrases, F.lit(False)))


def count_of(text: Column, char: str) -> Column:
    """How often one character is in the text."""
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


_WORD = "[A-Za-z0-9_]"


def _is_word(part: str, last: bool) -> bool:
    """Whether what part begins with (last: ends with) is surely an ASCII word character."""
    if last:
        part = re.sub(r"(?:\+|\{[1-9][0-9]*,?[0-9]*\})$", "", part)  # one or more
        if part.endswith("]"):
            begin = part.rfind("[")
            return _is_word(part[begin:], False) and part.count("]", begin) == 1
        if part.endswith(")"):
            begin, depth = len(part), 0
            while begin:
                begin -= 1
                depth += (part[begin] == ")") - (part[begin] == "(")
                if not depth:
                    break
            inner = part[begin:].removeprefix("(?:").removeprefix("(").removesuffix(")")
            return all(_is_word(x, True) for x in inner.split("|")) if "(" not in inner and "[" not in inner else False
        return bool(re.search(r"(?:^|[^\\])[A-Za-z0-9_]$", part)) or part.endswith(r"\w")
    if part.startswith("[") and "]" in part:
        body = part[1 : part.index("]")]
        optional = re.match(r"[?*]|\{0", part[part.index("]") + 1 :])
        return not optional and bool(re.fullmatch(r"(?:A-Z|a-z|0-9|\\w|\\d|[A-Za-z0-9_])+", body))
    if part.startswith("("):
        inner = re.match(r"\((?:\?:|\?i:)?([^()\[\]\\]*)\)(?![?*{])", part)
        if inner:
            return all(re.match("[A-Za-z0-9_]", x) for x in inner[1].split("|"))
        nested = re.match(r"\((?:\?:|\?i:)?(\[[^\]]*\][^()|]*)\)(?![?*]|\{0)", part)
        return bool(nested) and _is_word(nested[1], False)
    return bool(re.match(r"(?:[A-Za-z0-9_]|\\w)(?![?*]|\{0)", part))


def ascii_bounds(pattern: str) -> str:
    """The pattern with `\\b` as ASCII look-arounds: one where a word character surely stands on one side, else both ways."""
    parts = pattern.split(r"\b")
    out = parts[0]
    for before, after in zip(parts, parts[1:], strict=False):
        if _is_word(after, False):
            out += f"(?<!{_WORD})"
        elif _is_word(before, True):
            out += f"(?!{_WORD})"
        else:
            out += f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
        out += after
    return out


def _matches_nothing(pattern: str) -> bool:
    try:
        return re.match(pattern, "") is not None
    except re.error:  # Java's own syntax
        return False


def needed(pattern: str) -> tuple[list[str], bool]:
    """Literals one of which every match begins with, and whether case does not count; none where that can't be told."""
    blind = pattern.startswith("(?i:") and pattern.endswith(")")
    rest = pattern[4:-1] if blind else pattern
    depth, escaped, inside = 0, False, False
    for c in rest:
        if escaped:
            escaped = False
        elif c == "\\":
            escaped = True
        elif inside or c == "[":
            inside = c != "]"
        else:
            depth += (c == "(") - (c == ")")
            if c == "|" and not depth or depth < 0:
                return [], blind
    rest = rest.removeprefix(r"\b")
    group = re.match(r"\((?:\?:)?([A-Za-z0-9 _|]+)\)(?![?*{])", rest)
    if group:
        found = group[1].split("|")
    else:
        plain = re.match(r"[A-Za-z0-9_:/ -]+", rest)
        found = [plain[0][:-1] if rest[plain.end() :][:1] in ("?", "*", "{") else plain[0]] if plain else []
    return ([x.lower() if blind else x for x in found] if found and min(map(len, found)) > 1 else []), blind


#: Stands around matches while a text is cut into matches and what is between them.
_MARK = "\x01"
#: Matches whose places are summed at once.
_BLOCK = 128


def regex_spans(text: Column, pattern: str, entity_type: str = "match", confidence: float = 1.0, needs: Column | None = None) -> Column:
    """All matches as spans. A pattern that matches nothing at all is refused.

    needs: a cheap condition that every text with a match meets, unless the pattern's first literals give one. Texts without a match cost one look; in others all matches are marked in one
    pass, and the text is cut at the marks. (A text that has the mark in it is cut by the pattern.)
    """
    if _matches_nothing(pattern):
        raise ValueError(f"pattern matches an empty string: {pattern}")
    java = ascii_bounds(pattern)
    marked = F.split(F.regexp_replace(text, java, f"{_MARK}$0{_MARK}"), _MARK, -1)
    cut = F.flatten(F.zip_with(F.split(text, java, -1), F.regexp_extract_all(text, F.lit(java), F.lit(0)), lambda gap, match: F.when(match.isNull(), F.array(gap)).otherwise(F.array(gap, match))))
    pieces = F.when(F.contains(text, F.lit(_MARK)), cut).otherwise(marked)

    def spans(pieces: Column) -> Column:
        # Pieces are gap, match, gap, ... gap; a prefix sum over matches gives their ends.
        matches = F.sequence(F.lit(2), F.size(pieces) - 1, F.lit(2))
        sized = F.transform(matches, lambda i: F.struct(F.element_at(pieces, i).alias("m"), F.octet_length(F.element_at(pieces, i - 1)).alias("g")))
        empty = F.array().cast(SPANS)

        def add(state: Column, x: Column) -> Column:
            begin = state["at"] + x["g"]
            end = begin + F.octet_length(x["m"])
            span = F.struct(F.lit(entity_type).alias("entity_type"), x["m"].alias("text"), begin.alias("start"), end.alias("end"), F.lit(float(confidence)).alias("confidence"))
            return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

        def add_block(state: Column, block: Column) -> Column:
            done = F.aggregate(block, F.struct(state["at"].alias("at"), empty.alias("out")), add)
            return let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(state["out"], F.array(d["out"])).alias("out")))

        # Appending copies, so it is done in blocks.
        blocks = let(sized, lambda z: F.transform(F.sequence(F.lit(1), F.size(z), F.lit(_BLOCK)), lambda i: F.slice(z, i, F.lit(_BLOCK))))
        return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("out")), add_block, lambda s: F.flatten(s["out"]))

    if needs is None:
        literals, blind = needed(pattern)
        needs = has_any(F.lower(text) if blind else text, literals) if literals else None
    found = F.rlike(text, F.lit(java)) if needs is None else needs & F.rlike(text, F.lit(java))
    return F.when(found, let(pieces, spans)).otherwise(F.array().cast(SPANS))


def any_of(words) -> str:
    """An alternation of literal words: shorter ones first, and without those that hold a shorter one that ends before they do."""
    words = sorted(dict.fromkeys(words), key=len)
    kept = [w for i, w in enumerate(words) if not any(v in w[:-1] for v in words[:i])]
    return "|".join(map(re.escape, kept))


def count_class(text: Column, char_class: str) -> Column:
    """Characters of a class; runs are cut out whole."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{char_class}+", ""))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def entropy(text: Column, size: Column) -> Column:
    """Shannon entropy in bits of the characters, by a given length (0 for no text)."""
    chars = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / size
    value = F.aggregate(F.transform(chars, share), F.lit(0.0), lambda s, p: s - p * F.log2(p))
    return F.when(size > 0, value).otherwise(F.lit(0.0))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether 13 to 19 digits pass the checksum; separators are ignored."""

    def passes(d: Column) -> Column:
        n = F.length(d)

        def step(s: Column, i: Column) -> Column:
            x = F.substring(d, i, F.lit(1)).cast("int")
            twice = F.when(x * 2 > 9, x * 2 - 9).otherwise(x * 2)
            return s + F.when((n - i) % 2 == 1, twice).otherwise(x)

        return F.when(n.between(13, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0).otherwise(F.lit(False))

    return let(digits(number), passes)


def ipv4(address: Column) -> Column:
    parts = F.split(address, r"\.")
    return (F.size(parts) == 4) & F.forall(parts, lambda p: F.coalesce(p.try_cast("int").between(0, 255), F.lit(False)))


def ssn(number: Column) -> Column:
    area, group, serial = (F.element_at(F.split(number, "-"), i).try_cast("int") for i in (1, 2, 3))
    return F.coalesce((area != 0) & (area != 666) & (area < 900) & (group != 0) & (serial != 0), F.lit(False))


def severity_of(score: Column) -> Column:
    return F.when(score >= 0.9, "critical").when(score >= 0.7, "high").when(score >= 0.4, "medium").when(score > 0, "low").otherwise("none")


def severity_rank(name: Column) -> Column:
    return F.array_position(strings(SEVERITIES), name).cast("int") - 1


def graded(score: Column, *steps: tuple[float, str], other: str = "low") -> Column:
    """The first severity whose threshold the score reaches."""
    out = None
    for limit, name in steps:
        out = F.when(score >= limit, name) if out is None else out.when(score >= limit, name)
    return out.otherwise(other)


def factor(kind: str, description: Column | str, severity: Column, share: Column) -> Column:
    described = F.lit(description) if isinstance(description, str) else description
    return F.array(F.struct(F.lit(kind).alias("factor_type"), described.alias("description"), severity.alias("severity"), share.cast("double").alias("score_contribution")))


def result(scanner: str, text: Column, valid: Column, risk: Column, sanitized: Column | None = None, entities: Column | None = None, factors: Column | None = None, metadata: dict[str, Column] | None = None) -> Column:
    """The struct that every scanner returns; factors are given only where the text is invalid."""
    meta = F.create_map(*(x for k, v in (metadata or {}).items() for x in (F.lit(k), v.cast("string")))) if metadata else F.create_map().cast("map<string,string>")
    return F.struct(
        F.lit(scanner).alias("scanner"),
        (text if sanitized is None else sanitized).alias("sanitized_text"),
        valid.alias("is_valid"),
        risk.cast("double").alias("risk_score"),
        (F.array() if entities is None else entities).cast(SPANS).alias("entities"),
        F.when(~valid, F.array() if factors is None else factors).otherwise(F.array()).cast(FACTORS).alias("risk_factors"),
        meta.cast("map<string,string>").alias("metadata"),
    )
