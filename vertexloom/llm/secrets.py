"""Secret scans in SQL functions only: three fixed patterns, and runs of high Shannon entropy.

Places come from splitting a text at a pattern: the lengths of what lies between the matches and of the matches add up to offsets, in code points and in bytes. Entropy is
taken over windows of WINDOW characters that slide along candidate strings; each step adds one character to its count and takes one away, and the sum of
count * log2(count) changes by two looked-up terms, in whole multiples of 1 / SCALE, so that nothing drifts. Candidates of different character classes (of the whole
candidate) have thresholds of their own. Lists are folded in blocks, so the work grows with a text's length and spans, not with their product. One pass over the rows, no shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

# The patterns of the three kinds, with the least length of the group that decides.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "entropy")

#: Candidate strings, the window, and the entropy in bits from which a window counts, by class of the whole candidate. Candidates without a digit or a capital after a small
#: letter are words rather than keys, and left out like those of ALLOWED.
CANDIDATE, WINDOW = r"[A-Za-z0-9+/_=-]{20,}", 20
BITS = {"hex": 3.0, "letters": 4.0, "mixed": 3.7}
# Candidates that are no secrets. Version-like ids with dashes, words that mark examples, runs of one or two characters, alphabets, paths and
# words joined by dashes or underscores.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|dummy|placeholder|changeme|xxxx|your_|redacted",
    r"^(.{1,2})\1+.?$",
    r"(?i)abcdefghij|0123456789|qwertyuiop",
    r"^[/_=-]*[A-Za-z]+([/_=-]+([A-Za-z]+|[0-9]{1,4}))+[/_=-]*$",
)
#: Elements of a block of a fold; a count's bits, and counts in a number; what one bit of entropy is in whole numbers.
BLOCK, WIDE, PACKED, SCALE = 256, 5, 12, 1 << 32
#: Characters of candidates lie from code 43 to 122.
FIRST_CODE, CODES = 43, 80


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fold(xs: str, start: str, kind: str, step: str, of: str) -> str:
    """SQL for struct<p,r>: the last state, and what all steps emit, of a fold over the array in the variable xs.

    step is SQL over {of}b.p (the state so far) and {of}y (the element) for struct<p,o>: the next state, and an array<kind> of what is emitted. Arrays that grow by an element
    at a time are copied each time, so elements are folded in blocks of BLOCK and the blocks' results joined in the end.
    """
    block = f"""aggregate(slice({xs}, {of}a.i + 1, {BLOCK}), named_struct('p', {of}a.p, 'r', cast(array() as array<{kind}>)),
        ({of}b, {of}y) -> transform(array({step}), {of}o -> named_struct('p', {of}o.p, 'r', if(size({of}o.o) = 0, {of}b.r, concat({of}b.r, {of}o.o))))[0])"""
    return f"""aggregate(if(size({xs}) = 0, array(), sequence(0, size({xs}) - 1, {BLOCK})), named_struct('p', {start}, 'i', 0, 'r', cast(array() as array<array<{kind}>>)),
        ({of}a, {of}k) -> transform(array({block}), {of}z -> named_struct('p', {of}z.p, 'i', {of}a.i + {BLOCK}, 'r', concat({of}a.r, array({of}z.r))))[0],
        {of}a -> named_struct('p', {of}a.p, 'r', flatten({of}a.r)))"""


def let(name: str, value: str, body: str) -> str:
    """SQL for body with the variable name standing for value, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def matches(text: str, pattern: str) -> str:
    """SQL for array<struct<s,e,bs,be,m>>: start and end (exclusive) in code points, the same in bytes, and the string of each leftmost non-overlapping match in the column text."""
    found, gaps = f"regexp_extract_all({text}, {_quoted(pattern)}, 0)", f"split({text}, {_quoted(pattern)}, -1)"
    end = lambda x: f"mb.p.{x[0]} + {x[1]}(my.g) + {x[1]}(my.f)"
    chars, size = ("c", "length"), ("b", "octet_length")
    one = f"named_struct('s', mb.p.c + length(my.g), 'e', {end(chars)}, 'bs', mb.p.b + octet_length(my.g), 'be', {end(size)}, 'm', my.f)"
    step = f"named_struct('p', named_struct('c', {end(chars)}, 'b', {end(size)}), 'o', array({one}))"
    both = "zip_with(slice(mg, 1, size(mf)), mf, (g, f) -> struct(g, f))"  # the last gap has no match after it
    places = let("mx", let("mg", gaps, both), fold("mx", "named_struct('c', 0, 'b', 0)", "struct<s:int,e:int,bs:int,be:int,m:string>", step, "m") + ".r")
    return let("mf", found, f"if(size(mf) = 0, cast(array() as array<struct<s:int,e:int,bs:int,be:int,m:string>>), {places})")


def joined(spans: str) -> str:
    """SQL for array<struct<s,e>>: what the spans of the variable (with s and e, ordered by s) cover; those that overlap or touch are joined."""
    step = """if(jb.p.e >= jy.s, named_struct('p', named_struct('s', jb.p.s, 'e', greatest(jb.p.e, jy.e)), 'o', cast(array() as array<struct<s:int,e:int>>)),
        named_struct('p', named_struct('s', jy.s, 'e', jy.e), 'o', if(jb.p.e < 0, cast(array() as array<struct<s:int,e:int>>), array(jb.p))))"""
    return let("jf", fold(spans, "named_struct('s', -1, 'e', -1)", "struct<s:int,e:int>", step, "j"), "if(jf.p.e < 0, jf.r, concat(jf.r, array(jf.p)))")


def term(count: int) -> int:
    """count * log2(count) in whole multiples of 1 / SCALE."""
    return round(count * math.log2(count) * SCALE) if count else 0


def high_entropy(candidate: str) -> str:
    """SQL for array<struct<s,e>>: the joined windows of the candidate whose entropy reaches its class's threshold.

    The state holds the counts of the characters, PACKED to a number, the sum of count * log2(count) and the number of characters so far.
    """
    most = lambda bits: f"{math.floor((math.log2(WINDOW) - bits) * WINDOW * SCALE + 0.5)}L"  # noqa: E731  the greatest sum of a window that counts
    limit = f"""case when {candidate} rlike '^[0-9a-fA-F]+$' then {most(BITS["hex"])} when {candidate} rlike '^[^0-9]+$' then {most(BITS["letters"])} else {most(BITS["mixed"])} end"""
    grow = f"array({', '.join(f'{term(c + 1) - term(c)}L' for c in range(WINDOW + 1))})"
    one = lambda c: f"shiftleft(1L, {c} % {PACKED} * {WIDE})"
    count = lambda c: f"cast(shiftright(eb.p.n[{c} div {PACKED}], {c} % {PACKED} * {WIDE}) & {(1 << WIDE) - 1} as int)"
    # ey: the code that comes, v.z: the code that goes (-1: none yet)
    counts = f"transform(eb.p.n, (x, j) -> x + if(j = ey div {PACKED}, {one('ey')}, 0L) - if(v.z >= 0 and j = v.z div {PACKED}, {one('v.z')}, 0L))"
    total = f"eb.p.h + q.g[{count('ey')}] - if(v.z < 0, 0L, q.g[{count('v.z')} + if(v.z = ey, 1, 0) - 1])"
    out = f"if(eb.p.i + 1 >= {WINDOW} and h <= q.b, array(named_struct('s', eb.p.i + 1 - {WINDOW}, 'e', eb.p.i + 1)), cast(array() as array<struct<s:int,e:int>>))"
    step = let("v", f"named_struct('z', if(eb.p.i >= {WINDOW}, q.c[eb.p.i - {WINDOW}], -1))", let("h", total, f"named_struct('p', named_struct('n', {counts}, 'h', h, 'i', eb.p.i + 1), 'o', {out})"))
    windows = fold("qc", f"named_struct('n', array_repeat(0L, {-(-CODES // PACKED)}), 'h', 0L, 'i', 0)", "struct<s:int,e:int>", step, "e") + ".r"
    codes = f"filter(transform(split({candidate}, ''), x -> ascii(x) - {FIRST_CODE}), x -> x >= 0)"
    return let("q", f"named_struct('c', {codes}, 'g', {grow}, 'b', {limit})", let("qc", "q.c", let("w", windows, joined("w"))))


def scan(df: DataFrame, text: str = "text", allowed: tuple[str, ...] = ALLOWED) -> Column:
    """A column array<struct<s,k,e,bs,be>> of df: all spans of a text (k: place in KINDS; bs and be: the same in bytes), ordered by start, then kind; null texts have none.

    An entropy span that overlaps one of the other kinds is left out, as is one in an allowed candidate.
    """
    column = f"coalesce(`{text}`, '')"
    span = lambda kind: f"named_struct('s', x.s, 'k', {KINDS.index(kind)}, 'e', x.e, 'bs', x.bs, 'be', x.be)"
    # the groups of one pattern run along with its matches
    assign = let("v", f"regexp_extract_all({column}, {_quoted(ASSIGN)}, 2)", f"""transform(filter(zip_with({matches(column, ASSIGN)}, v,
        (m, w) -> named_struct('s', m.s, 'e', m.e, 'bs', m.bs, 'be', m.be, 'n', length(w))), x -> x.n >= {LEAST["assign"]}), x -> {span("assign")})""")
    access = f"transform(filter({matches(column, ACCESS)}, x -> x.e - x.s >= {LEAST['access']}), x -> {span('access')})"
    # a maximal run that is long enough is the same as a long enough part of pattern HEX, without the short runs that most words have
    hexes = f"transform({matches(column, HEX[:-1] + f'{{{LEAST["hex"]},}}')}, x -> {span('hex')})"
    no = " ".join(f"and not c.m rlike {_quoted(p)}" for p in allowed)
    entropy = f"""flatten(transform(filter({matches(column, CANDIDATE)}, c -> (c.m rlike '[0-9]' or c.m rlike '[a-z][A-Z]') {no}),
        c -> transform({high_entropy("c.m")}, w -> named_struct('s', c.s + w.s, 'k', 3, 'e', c.s + w.e, 'bs', c.bs + w.s, 'be', c.bs + w.e))))"""
    # in order of starts, an entropy span meets a base span before it if the furthest end so far is beyond its start, and one after it in the same way read from the end
    kind = "struct<s:int,k:int,e:int,bs:int,be:int>"
    first = "named_struct('p', if(fy.k = 3, fb.p, greatest(fb.p, fy.e)), 'o', if(fy.k = 3 and fb.p > fy.s, cast(array() as array<%s>), array(fy)))" % kind
    last = "named_struct('p', if(gy.k = 3, gb.p, least(gb.p, gy.s)), 'o', if(gy.k = 3 and gb.p < gy.e, cast(array() as array<%s>), array(gy)))" % kind
    every = let("fx", f"array_sort(concat(base, {entropy}))", fold("fx", "-1", kind, first, "f") + ".r")
    both = let("gx", f"reverse({every})", f"reverse({fold('gx', '2147483647', kind, last, 'g')}.r)")
    return F.expr(let("base", f"concat({assign}, {access}, {hexes})", both))


def written(spans: str) -> str:
    """SQL for spans as kind:start:end, joined by commas."""
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, x -> concat(array({kinds})[x.k], ':', x.s, ':', x.e)), ',')"


def find(df: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_entropy of every row.

    Null and empty texts have no spans and the digest of nothing. Equal rows stay apart; further columns are not read.
    """
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), scan(df).alias("x"))
    n = lambda kind: F.expr(f"cast(size(filter(x, y -> y.k = {KINDS.index(kind)})) as long)").alias(f"n_{kind}")
    return rows.select("doc_id", n("assign"), n("access"), n("hex"), F.expr(f"sha2({written('filter(x, y -> y.k < 3)')}, 256)").alias("base_sha256"), F.expr(written("x")).alias("spans"), n("entropy"))


def redact(df: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """df with the spans of text replaced by mark, overlapping ones by one; null texts stay null. Other columns stay as they are, whatever their names."""
    name = free_name(df, "spans")
    part = lambda start, size: f"cast(substring(raw, {start} + 1, {size}) as string)"  # noqa: E731  bytes are found at once, code points only by counting
    # what lies between the furthest end so far and a span that starts beyond it, and the mark
    step = f"""named_struct('p', greatest(rb.p, ry.be), 'o', if(ry.bs < rb.p, cast(array() as array<string>), array({part("rb.p", "ry.bs - rb.p")}, {_quoted(mark)})))"""
    whole = let("rf", fold("rx", "0", "string", step, "r"), f"concat(array_join(rf.r, ''), {part('rf.p', 'octet_length(text)')})")
    text = F.expr(f"if(size(`{name}`) = 0, text, {let('raw', 'cast(text as binary)', let('rx', f'`{name}`', whole))})")
    return df.withColumn(name, scan(df)).withColumn("text", text).drop(name)
