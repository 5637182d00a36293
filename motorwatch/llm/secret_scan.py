"""Secret scans by sliding-window entropy, in DataFrame functions only.

Three base patterns are matched first: assignments, access keys and long hexadecimal runs. The method adds to them: every
maximal run of key characters of at least ``WINDOW`` is a candidate, and a window of that width slides over it. Counts per
character are kept as the window moves, one character enters and one leaves, and with them the sum of ``c * log2(c)``, in
whole millionths, so that no rounding builds up; the Shannon entropy is ``log2(width) - sum / width``. The limit
depends on the character class of the candidate (the narrowest of hexadecimal, letters of one case with digits, all key characters).
Windows at or above the limit are joined where they overlap or touch, each union is a span of kind ``entropy``. The allow list
suppresses candidates first: numbers, names without digits, slugs of words and short numbers, UUIDs, placeholders, and any pattern
given. What lies inside a base span is reported by that span only.

Places are code points. Spark's functions return matches without places, so they are taken from the lengths of the
matches and of the pieces between them. A document is one row throughout: nothing is shuffled, nothing leaves the JVM.

Defined results: a NULL or empty text has no spans; matches of one kind do not overlap, those of different kinds may; repeated
documents have equal spans; no documents give no rows; ``row`` carries all columns, so no name can clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_row

WINDOW = 20
UNIT = 1_000_000
#: Characters of candidates, in the order of their counters.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Class, narrowest first: (characters, limit in bits for a window). Random keys lie about 0.3 above their limit, words below.
CLASSES = {
    "hex": ("^([0-9a-f]+|[0-9A-F]+)$", 3.0),
    "one case": ("^([0-9a-z]+|[0-9A-Z]+)$", 3.5),
    "all": ("", 3.75),
}
ALLOWED = (
    "^[0-9+/_=-]*$",
    "^[A-Za-z+/_=-]*$",
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|0000|1234567|abcdefg",
)
#: A slug is made of such parts: a word with a short number behind it, or a number.
SLUG_BREAK, SLUG_PART = "[+/_=-]+", "^([A-Za-z]*[0-9]{0,4}|[0-9]{0,8})$"


def either_case(words: str) -> str:
    """The pattern with each letter in either case, spelled out: engines fold other letters into ASCII differently."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


#: Kind: (pattern, group whose length counts, characters it needs), in the order in which kinds are listed.
BASE = {
    "assign": (either_case("(password|passwd|secret|token|api_?key)") + "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    "access": ("AKIA[A-Z0-9]+", 0, 16),
    "hex": ("[0-9a-f]{32,}", 0, 32),
}
KINDS = (*BASE, "entropy")
_BLOCK = 512


def log_sums(window: int = WINDOW) -> list[int]:
    """``c * log2(c)`` in millionths for c = 0 ... window."""
    return [0, *[round(c * math.log2(c) * UNIT) for c in range(1, window + 1)]]


def highest_sum(limit: float, window: int = WINDOW) -> int:
    """The highest sum of these at which a full window still has an entropy of ``limit`` bits."""
    return round(window * (math.log2(window) - limit) * UNIT)


def _let(value: str, body: str, name: str = "it") -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _running(steps: str) -> str:
    """SQL: running sums of an array. Blocks first, so that arrays of many thousand are not copied once per element."""
    fold = "aggregate({}, cast(array() as array<int>), (a, x) -> array_append(a, x + coalesce(try_element_at(a, -1), 0)))"
    safe = "if(size({0}) = 0, cast(array() as array<{1}>), {2})"
    blocks = f"transform(sequence(0, (size(steps) - 1) div {_BLOCK}), b -> slice(steps, b * {_BLOCK} + 1, {_BLOCK}))"
    local = safe.format("steps", "array<int>", f"transform({blocks}, k -> {fold.format('k')})")
    ends = fold.replace("(a, x)", "(d, y)").replace("array_append(a, x + coalesce(try_element_at(a, -1), 0))", "array_append(d, y + coalesce(try_element_at(d, -1), 0))")
    offsets = ends.format("transform(parts, p -> element_at(p, -1))")
    joined = _let(offsets, "flatten(transform(parts, (p, n) -> transform(p, v -> v + if(n = 0, 0, offs[n - 1]))))", "offs")
    return _let(steps, _let(local, joined, "parts"), "steps")


def places(text: str, pattern: str, group: int = 0) -> str:
    """SQL: array of (start, end, length of the group, match) of the leftmost matches that do not overlap."""
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    steps = "transform(m, (x, i) -> length(g[i]) + if(i = 0, 0, length(m[i - 1])))"
    made = f"zip_with(zip_with(m, {_running(steps)}, (x, s) -> struct(s as start, s + length(x) as stop, x as said)), c, (x, n) -> struct(x.start, x.stop, length(n) as size, x.said))"
    counted = f"regexp_extract_all({text}, '{quoted}', {group})" if group else "m"
    found = _let(f"regexp_extract_all({text}, '{quoted}', 0)", _let(f"split({text}, '{quoted}', -1)", _let(counted, made, "c"), "g"), "m")
    none = "cast(array() as array<struct<start: int, stop: int, size: int, said: string>>)"
    return f"if({text} rlike '{quoted}', {found}, {none})"


def _entropy_spans(window: int) -> str:
    """SQL over ``codes`` (places in the alphabet, from 1) and ``top``: array of (a, b), the unions of windows whose sum is at most ``top``."""
    sums = ", ".join(map(str, log_sums(window)))
    # One step: the character that leaves, then the one that enters; counts and the sum follow.
    out = f"if(i > {window}, codes[i - 1 - {window}], 0)"
    gone = _let(out, "struct(o as o, st.e - if(o = 0, 0L, f[st.n[o]] - f[st.n[o] - 1]) as e)", "o")
    entered = _let(
        gone,
        _let(
            "codes[i - 1]",
            "struct(transform(st.n, (c, j) -> c + if(j = k, 1, 0) - if(j = r.o, 1, 0)) as n, "
            "r.e + f[st.n[k] - if(k = r.o, 1, 0) + 1] - f[st.n[k] - if(k = r.o, 1, 0)] as e)",
            "k",
        ),
        "r",
    )
    hot = f"i >= {window} and s.e <= top"
    step = _let(
        entered,
        f"case when not ({hot}) then struct(s.n as n, s.e as e, st.a as a, st.b as b, st.found as found) "
        f"when st.b >= i - {window} and st.b > 0 then struct(s.n as n, s.e as e, st.a as a, i as b, st.found as found) "
        f"else struct(s.n as n, s.e as e, i - {window} as a, i as b, if(st.b > 0, array_append(st.found, struct(st.a as a, st.b as b)), st.found) as found) end",
        "s",
    )
    begin = (
        f"struct(array_repeat(0, {len(ALPHABET) + 1}) as n, 0L as e, 0 as a, 0 as b, cast(array() as array<struct<a: int, b: int>>) as found)"
    )
    finish = "if(st.b > 0, array_append(st.found, struct(st.a as a, st.b as b)), st.found)"
    return _let(f"array({', '.join(x + 'L' for x in sums.split(', '))})", f"aggregate(sequence(1, size(codes)), {begin}, (st, i) -> {step}, st -> {finish})", "f")


def _allowed(said: str, allowed: tuple[str, ...]) -> str:
    quoted = [a.replace("\\", "\\\\").replace("'", "\\'") for a in (*allowed, SLUG_PART)]
    listed = [f"{said} rlike '{a}'" for a in quoted[:-1]]
    slug = f"forall(split({said}, '{SLUG_BREAK}', -1), p -> p rlike '{quoted[-1]}')"
    return " or ".join([*listed, slug])


def _added(text: str, allowed: tuple[str, ...], window: int) -> str:
    """SQL over ``base``: spans of high entropy outside the base spans."""
    tops = "case " + " ".join(f"when said rlike '{p}' then {highest_sum(h, window)}L" for p, h in CLASSES.values() if p)
    tops += f" else {highest_sum(CLASSES['all'][1], window)}L end"
    codes = f"transform(split(x.said, ''), c -> instr('{ALPHABET}', c))"
    spans = _let(codes, _let(tops.replace("said", "x.said"), _entropy_spans(window), "top"), "codes")
    moved = f"transform({spans}, y -> struct(x.start + y.a as start, {KINDS.index('entropy')} as kind, x.start + y.b as stop))"
    fresh = f"filter({places(text, CANDIDATE.replace(str(WINDOW), str(window)))}, x -> not ({_allowed('x.said', allowed)}))"
    every = f"flatten(transform({fresh}, x -> {moved}))"
    return f"filter({every}, x -> not exists(base, b -> b.start <= x.start and x.stop <= b.stop))"


def find_secrets(docs: DataFrame, text: str = "text", allowed: tuple[str, ...] = ALLOWED, window: int = WINDOW) -> DataFrame:
    """``row`` (the document), ``n_assign``, ``n_access``, ``n_hex`` and ``found``: (start, kind as number, stop), sorted; base ones are those of the first kinds.

    ``allowed`` are patterns looked for in a candidate; a match suppresses it.
    """
    given = docs.select(whole_row(docs).alias("row"), F.coalesce(docs[text], F.lit("")).alias("t"))
    kept = [
        f"transform(filter({places('t', pattern, group)}, x -> x.size >= {least}), x -> struct(x.start as start, {at} as kind, x.stop as stop))"
        for at, (pattern, group, least) in enumerate(BASE.values())
    ]
    base = given.withColumn("base", F.expr(f"array_sort(concat({', '.join(kept)}))"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {at})) as bigint)").alias(f"n_{kind}") for at, kind in enumerate(BASE)]
    return base.select("row", *counts, F.array_sort(F.concat("base", F.expr(_added("t", allowed, window)))).alias("found"))


def listed(found: Column, base_only: bool = False) -> Column:
    """The spans as ``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    chosen = F.filter(found, lambda x: x.kind < len(BASE)) if base_only else found
    return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", names[x.kind], x.start, x.stop)), ",")


def redact(scanned: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``row`` and ``redacted``: the text with each union of overlapping spans replaced by ``mark``; NULL stays NULL."""
    t = f"row.`{text}`"
    step = (
        f"if(x.stop <= a.at, a, struct(concat(a.said, if(x.start > a.at, concat(substring({t}, a.at + 1, x.start - a.at), '{mark}'), if(a.at = 0, '{mark}', ''))) as said, x.stop as at))"
    )
    whole = f"aggregate(found, struct('' as said, 0 as at), (a, x) -> {step}, a -> concat(a.said, substring({t}, a.at + 1)))"
    return scanned.select("row", F.expr(whole).alias("redacted"))
