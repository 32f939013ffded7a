r"""Line deduplication by a segment-partition edit join.

Lines are compared over the whole corpus: equal ones at any length (but blank
lines), and from ``MIN_CHARS`` characters on those within ``TAU`` edits of each
other (Li, Deng, Wang and Feng, "Pass-Join"; under 20 characters two edits are
a tenth of the line and more, so such lines only count when equal).  A line is
dropped if an equal one, or a linked one, stands earlier in the order of
(doc_id, hash of the text, line number).

* First the lines that can have a partner are found.  tau edits leave one of
  tau + 1 stretches untouched, whose place is known up to a few characters from
  the line's start or end; stretches are cut by the length rounded down to a
  grid, so that lines of nearly equal length cut alike.  A line is a possible
  partner if it shares the hash of such a stretch with another line: one sum
  over 8-byte keys, without pairs and without text.
* The possible partners are cut into TAU + 1 segments.  A line of length l is
  indexed by (l, segment number, segment); a line of length L probes the indexes
  of lengths L - TAU to L with the few substrings that the multi-match-aware
  windows leave.
* Lines that share a key meet in pairs only while they are few (``CROWD``).  In
  a crowded key every line meets the earliest one first; a line that is linked
  to it needs no further partner.  The others are cut into ``CELLS`` cells and
  meet again where all but one cell agree, or all but TAU; if such a key is
  crowded as well, the first touched cell, which then holds one edit, joins the
  key, whole and without each of its characters.  Only lines that agree on all
  but one cell and stay unresolved meet the whole of their key.  So rows stay
  linear in a group of lines that are all alike and in one whose lines differ
  here and there, and no line that has an earlier partner goes unresolved.  That
  decides what is dropped (``linked``); ``every`` link is found without the
  earliest line: crowded keys are only cut finer, no line counts as resolved, and
  what is left of a key meets in pairs, so rows grow with the links.
* Two lines only become a candidate if their signatures agree: 64 bits, each the
  parity of the number of characters that hash to it.  An edit changes two bits
  at most, so those of linked lines differ in 2 TAU at most.
* Candidates lose the characters that both begin and end with, and the rest is
  verified with a banded bit-parallel edit distance: a band of 2 TAU + 1 cells
  is one integer, updated once for each character.

A line's class is its component over every link; the earliest line of a class
stays and stands for it.  Everything is DataFrame expressions.

Text is read once for the hashes (stored as a table of about 90 bytes a line),
again for the documents that hold possible partners, and at the end.  It is
shuffled only for the possible partners, and for the whole if the lists of
dropped lines exceed a counted bound.

Defined cases: null is the empty text, one blank line; lines end at ``\n``;
rows that repeat a ``doc_id`` and text are one document, those that repeat an
id with another text are documents of their own; rows without an id are not
compared and stay whole; an empty table gives an empty result; other columns
pass unchanged.  Lines are told apart by 128 bits of hash.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import keep, partitions, read, small
from plumbline.llm.components import components

TAU = 2
MIN_CHARS = 20
#: Lengths are rounded down to multiples of the first (from LONG characters on of the second) before partners are sought.
GRID = (4, 16)
LONG = 64
#: Lines that share a key and meet in pairs at most; the result doesn't depend on it.
CROWD = 32
#: Cells of the second cut.
CELLS = 7
#: Rows of keys, marks and dropped places (8 to 60 bytes each) that are broadcast at most.
BROADCAST_ROWS = 200_000
_STEPS = [4 << k for k in range(20, -1, -1)]


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), pos, line; docs: doc_id, text."""
    # the outer form keeps the optimizer from deriving a filter that splits every text a second time
    return docs.select("doc_id", F.xxhash64("text").alias("t"), F.posexplode_outer(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))


def _blank(c: str) -> Column:
    return F.expr(f"trim(BOTH ' \\t\\r\\n' FROM {c}) = ''")


# --- possible partners


def _stretches(tau: int) -> list[str]:
    """SQL for the hashes of a line's stretches, of ``line``, ``bytes``, ``n`` characters and the rounded lengths ``base0``
    (of n) and ``base1`` (of n - tau; two lengths that differ by tau at most have one in common).

    Stretch i of tau + 1 is untouched, with i - 1 edits before it at most and tau + 1 - i behind it, for some i.  So it is
    found from the nearer end, off by at most ``off`` places; of the windows at 0 to off places, shorter by ``off``, one
    of each line's agree."""
    out = []
    for base in ("base0", "base1"):
        width = f"({base} div {tau + 1})"
        for i in range(1, tau + 2):
            off = min(i - 1, tau + 1 - i)
            for j in range(off + 1):
                start = f"{width} * {i - 1} + {1 + j}" if i - 1 <= tau + 1 - i else f"n - {width} * {tau + 2 - i} + {1 + j}"
                place = f"int({start}), int({width} - {off})"
                # of ASCII the bytes are the characters; a substring of text has to walk
                key = f"xxhash64(if(octet_length(line) = n, substring(bytes, {place}), CAST(substring(line, {place}) AS BINARY)), {base} * {tau + 1} + {i})"
                out.append(key if base == "base0" else f"if(base1 < base0, {key}, NULL)")
    return out


def line_table(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, t, pos, h, h2, keys of every line but blank ones; keys only of lines that are compared by edits."""
    if min_chars < 4 * (tau + 1) or GRID[0] < tau:
        raise ValueError(f"lines of {4 * (tau + 1)} characters at least can be compared by edits")
    rounded = lambda n: f"({n} - {n} % if({n} < {LONG}, {GRID[0]}, {GRID[1]}))"
    lines = _lines(docs).where(~_blank("line")).withColumns({"n": F.char_length("line"), "bytes": F.col("line").cast("binary")})
    lines = lines.withColumns({"base0": F.expr(rounded("n")), "base1": F.expr(rounded(f"(n - {tau})"))})
    keys = F.when(F.col("n") >= min_chars, F.expr(f"array({', '.join(_stretches(tau))})"))
    return keep(lines.select("doc_id", "t", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"), keys.alias("keys")), "line-keys")


def partners(docs: DataFrame, table: DataFrame) -> DataFrame:
    """id (rising with the place), h, h2, doc_id, n (characters), u (these at four bytes each) of lines that share a stretch with another."""
    rows = table.select("h", "h2", "doc_id", "t", "pos", F.explode_outer("keys").alias("key")).where("key IS NOT NULL")
    shared = keep(rows.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select(F.col("key").alias("shared")), "line-shared")
    some = rows.join(small(shared, shared.count(), BROADCAST_ROWS), F.col("key") == F.col("shared"), "left_semi")
    firsts = keep(some.groupBy("h", "h2").agg(F.min(F.struct("doc_id", "t", "pos")).alias("first")).select("h", "h2", "first.*"), "line-firsts")
    n = firsts.count()
    holders = small(firsts.select(F.col("doc_id").alias("holder")).distinct(), n, BROADCAST_ROWS)
    lines = _lines(docs.join(holders, F.col("doc_id") == F.col("holder"), "left_semi"))
    found = lines.join(small(firsts, n, BROADCAST_ROWS), ["doc_id", "t", "pos"]).dropDuplicates(["h", "h2"])
    found = found.orderBy("doc_id", "t", "pos").select(F.monotonically_increasing_id().alias("id"), "h", "h2", "doc_id", F.char_length("line").alias("n"), F.expr("encode(line, 'UTF-32')").alias("u"))
    return keep(found, "line-partners")


# --- keys of the possible partners

#: SQL for the parities of a line's characters (each by the bit that it hashes to), of ``u``.
SIGNATURE = "aggregate(split(decode(u, 'UTF-32'), ''), 0L, (s, c) -> s ^ shiftleft(1L, int(xxhash64(c) & 63L)))"


def _similar(tau: int) -> Column:
    """Whether two lines with the signatures sig and sig2 can be within tau edits."""
    return F.bit_count(F.col("sig").bitwiseXOR(F.col("sig2"))) <= 2 * tau


def _window(i: int, shorter: int, tau: int) -> range:
    """Where segment i of a line can stand in one that is longer by ``shorter``, relative to its place (multi-match-aware)."""
    return range(max(-(i - 1), shorter - (tau + 1 - i)), min(i - 1, shorter + (tau + 1 - i)) + 1)


def _keyed(lines: DataFrame, ways: list[tuple], names: str, parts: list[tuple[str, str, str]], salt: str) -> DataFrame:
    """key, id, sig, own and the way, of each line for each way to cut it (values of ``names``; the first is by how much an indexed
    line is shorter, the second whether anything is shifted): the hash of the parts (from, to, shift; characters of the
    indexed line).  ``own`` marks the keys under which a line is indexed."""
    ways = ", ".join(f"named_struct({', '.join(f"'{n}', {v}" for n, v in zip(names.split(), way, strict=True))})" for way in ways)
    rows = lines.select("id", "sig", "n", "u", F.explode(F.expr(f"array({ways})")).alias("way")).select("id", "sig", "n", "u", "way.*").withColumn("l", F.expr("n - shorter"))
    cut = ", ".join(f"substring(u, int(4 * (({a}) + {o}) + 1), int(4 * (({b}) - ({a}))))" for a, b, o in parts)
    return rows.select(F.expr(f"xxhash64(l, {salt}, {cut})").alias("key"), "id", "sig", F.expr("shorter = 0 AND shift = 0").alias("own"), *names.split()[2:], "l")


def segment_keys(lines: DataFrame, tau: int) -> DataFrame:
    """Keys of one untouched segment of tau + 1."""
    ways = [(s, o, i) for s in range(tau + 1) for i in range(1, tau + 2) for o in _window(i, s, tau)]
    edge = lambda i: f"(l * ({i}) div {tau + 1})"
    return _keyed(lines, ways, "shorter shift i", [(edge("i - 1"), edge("i"), "shift")], "i").select("key", "id", "sig", "own")


def cell_keys(lines: DataFrame, tau: int, cells: int, touched: int) -> DataFrame:
    """Keys of all cells but the touched ones, each of which holds tau + 1 - touched edits at most: what stands between two of
    them is shifted by what the edits before it add.  c0 and s1: the first touched cell, and by how much it is longer; fixed:
    whether the key would hold as well if that cell weren't longer."""
    most = tau + 1 - touched
    nets = [(0,)]  # by how much the first 0, 1, ... touched cells lengthen the line
    for _ in range(touched):
        nets = [(*n, n[-1] + x) for n in nets for x in range(-most, most + 1)]
    nets = [n for n in nets if 0 <= n[-1] and sum(abs(b - a) for a, b in itertools.pairwise(n)) <= tau]
    ways = [(n[-1], int(any(n)), *n[1:], *places) for n in nets for places in itertools.combinations(range(cells), touched)]
    shifts, places = [f"s{j + 1}" for j in range(touched)], [f"c{j}" for j in range(touched)]
    edge = lambda i: f"(l * ({i}) div {cells})"
    parts = [(edge(a), edge(b), o) for a, b, o in zip(["0", *[f"{c} + 1" for c in places]], [*places, str(cells)], ["0", *shifts], strict=True)]
    return _keyed(lines, ways, " ".join(["shorter", "shift", *shifts, *places]), parts, ", ".join([str(touched), *places])).select("key", "id", "sig", "own", "c0", "s1", F.expr(f"s1 = 0{' OR c1 = c0 + 1' if touched > 1 else ''}").alias("fixed"), "l")


def variant_keys(rows: DataFrame, lines: DataFrame, cells: int) -> DataFrame:
    """Rows of ``cell_keys`` where each touched cell holds one edit at most: the key with the first touched cell, whole and
    without one of its characters.  Two cells that are one edit apart have one of these in common.  kind: the cell at the
    length of the indexed line's, if the key holds for that too; lines that have it alike touch one cell less and meet there."""
    cell = rows.join(lines.select("id", "u"), "id").withColumn("at", F.expr(f"l * c0 div {cells}")).withColumn("size", F.expr(f"int(l * (c0 + 1) div {cells} - at + s1)"))
    cell = cell.withColumn("cell", F.expr("substring(u, int(4 * at + 1), 4 * size)")).withColumn("kind", F.expr("if(fixed, xxhash64(substring(u, int(4 * at + 1), 4 * int(size - s1))), NULL)"))
    cell = cell.select("key", "id", "sig", "own", "cell", "size", "kind").repartition(partitions(lines.sparkSession))
    # what is left is hashed in one piece, so that a whole cell agrees with a longer one that lost a character anywhere
    each = cell.select("key", "id", "sig", "own", "cell", "size", "kind", F.explode(F.sequence(F.lit(0), F.col("size"))).alias("without"))
    return each.select(F.expr("xxhash64(key, concat(substring(cell, 1, 4 * without), substring(cell, 4 * without + 5, 4 * size)))").alias("key"), "id", "sig", "own", "kind")


# --- verification


def _trimmed(then: str) -> Column:
    """The SQL ``then`` of c.xs and c.ys: the characters of x and y (given at four bytes each) without what both begin and
    end with.  One expression, in which each step is evaluated once."""
    shorter = "least(octet_length(x), octet_length(y))"
    steps = f"array({', '.join(map(str, _STEPS))})"  # binary search; what is beyond 2 ** 21 characters is left to the verification
    begin = f"aggregate({steps}, 0, (p, w) -> p + if(p + w <= {shorter} AND substring(x, p + 1, w) = substring(y, p + 1, w), w, 0))"
    last = "substring({0}, octet_length({0}) - q - w + 1, w)"
    end = f"aggregate({steps}, 0, (q, w) -> q + if(q + w <= {shorter} AND {last.format('x')} = {last.format('y')}, w, 0))"
    chars = lambda z: f"array_remove(split(decode(substring({z}, c.p + 1, octet_length({z}) - c.p - least(c.q, {shorter} - c.p)), 'UTF-32'), ''), '')"
    cut = f"transform(array(named_struct('p', {begin}, 'q', {end})), c -> named_struct('xs', {chars('x')}, 'ys', {chars('y')}))"
    return F.expr(f"transform({cut}, c -> {then})[0]")


def within(a: str, b: str, tau: int = TAU) -> str:
    """SQL for whether two columns of characters (arrays of strings), of lengths that differ by tau at most, are within tau edits.

    Bit k of the band at character j of b stands for character j - tau + k of a.
    vp and vn are the cells where the distance rises or falls downward, d0 those
    equal to their upper left neighbour; the distance is read off the diagonal
    that ends in the last cell, along which it never falls, so that nothing more
    is done once it is above tau.
    """
    full, diagonal = (1 << (2 * tau + 1)) - 1, f"size({a}) - size({b}) + {tau}"
    match = " | ".join(f"if(get({a}, j - {tau + 1 - k}) <=> get({b}, j - 1), {1 << k}L, 0L)" for k in range(2 * tau + 1))
    hp, hn = f"(s.vn | ~(d | s.vp)) & {full}L", "d & s.vp"
    step = f"""if(s.n > {tau}, s, transform(transform(array({match}), m -> ((((m & s.vp) + s.vp) ^ s.vp) | m | s.vn) & {full}L), d -> named_struct(
        'vp', (({hn}) | ~(shiftright(d, 1) | ({hp}))) & {full}L,
        'vn', shiftright(d, 1) & ({hp}),
        'n', s.n + if((shiftright(d, {diagonal}) & 1L) = 1L, 0, 1)))[0])"""
    start = f"named_struct('vp', {full & ~((1 << tau) - 1)}L, 'vn', 0L, 'n', greatest(size({a}) - size({b}), 0))"
    return f"CASE WHEN size({b}) = 0 THEN size({a}) <= {tau} WHEN size({a}) = 0 THEN size({b}) <= {tau} ELSE aggregate(sequence(1, size({b})), {start}, (s, j) -> {step}, s -> s.n) <= {tau} END"


def verified(pairs: DataFrame, lines: DataFrame, tau: int = TAU) -> DataFrame:
    """early, late of the candidate pairs (early, late) that are within tau edits."""
    text = lines.select("id", "n", "u")
    both = pairs.join(text.select(F.col("id").alias("early"), F.col("n").alias("nx"), F.col("u").alias("x")), "early").join(text.select(F.col("id").alias("late"), F.col("n").alias("ny"), F.col("u").alias("y")), "late")
    # dealt evenly: the work is in the pairs, not in their bytes
    both = both.where(F.abs(F.col("nx") - F.col("ny")) <= tau).repartition(partitions(lines.sparkSession), "early", "late")
    return both.where(_trimmed(within("c.xs", "c.ys", tau))).select("early", "late")


def _meet(rows: DataFrame, lines: DataFrame, tau: int, crowd: int, resolved: DataFrame | None, every: bool) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(links, resolved, crowded): lines that share a key (rows: key, id, sig, own, kind, null: a kind of its own) of two kinds at least meet in pairs if they
    are ``crowd`` at most, else all meet the earliest.  Resolved lines have an earlier partner and need no other.  crowded: key, id, sig, kind, lo and late (whether
    the line is unresolved) of the crowded keys with unresolved lines.  With ``every`` none meets the earliest alone and none is resolved."""
    rows = keep(rows.groupBy("key", "id").agg(F.max("own").alias("own"), F.coalesce(F.min("kind"), F.xxhash64("id")).alias("kind"), F.min("sig").alias("sig")), "line-rows")
    met = rows.groupBy("key").agg(F.min("id").alias("lo"), F.count(F.lit(1)).alias("c"), F.max("own").alias("own"), F.min("kind").alias("k0"), F.max("kind").alias("k1")).where("own AND k0 <> k1")
    met = keep(met.select(F.col("key").alias("met"), "lo", "c"), "line-met")
    n_met, n_crowded = met.agg(F.count(F.lit(1)), F.count_if(F.col("c") > crowd)).first()
    inside = keep(rows.select("key", "id", "sig", "kind").join(small(met, n_met, BROADCAST_ROWS), F.col("key") == F.col("met")).drop("met"), "line-inside")
    few, many = inside.where(F.col("c") <= crowd), inside.where(F.col("c") > crowd)
    later = few.select("key", F.col("id").alias("late"), F.col("kind").alias("other"), F.col("sig").alias("sig2"))
    pairs = few.select("key", F.col("id").alias("early"), "kind", "sig").join(later, "key").where("early < late AND kind <> other").where(_similar(tau)).select("early", "late")
    if n_crowded and not every:
        pairs = pairs.unionByName(many.where("id <> lo").select(F.col("lo").alias("early"), F.col("id").alias("late")))
    if resolved is not None:
        pairs = pairs.join(resolved, F.col("late") == F.col("done"), "left_anti")
    links = keep(verified(pairs.distinct(), lines, tau), "line-links")
    if every:
        return links, None, many.select("key", "id", "sig", "kind", "lo", F.lit(True).alias("late")) if n_crowded else None
    now = links.select(F.col("late").alias("done"))
    resolved = keep((now if resolved is None else now.unionByName(resolved)).distinct(), "line-resolved")
    if not n_crowded:
        return links, resolved, None
    crowded = many.join(resolved, F.col("id") == F.col("done"), "left").select("key", "id", "sig", "kind", "lo", (F.col("done").isNull() & (F.col("id") != F.col("lo"))).alias("late"))
    unresolved = crowded.groupBy(F.col("key").alias("unresolved")).agg(F.max("late").alias("any")).where("any").drop("any")
    crowded = keep(crowded.join(unresolved, F.col("key") == F.col("unresolved"), "left_semi"), "line-crowded")
    return links, resolved, None if crowded.isEmpty() else crowded


def linked(lines: DataFrame, tau: int = TAU, crowd: int = CROWD, cells: int = CELLS, every: bool = False) -> DataFrame:
    """early, late: links between lines (id, n, u) that give every line with an earlier partner one at least; with ``every``
    all links there are, each once."""
    found = _linked(lines, tau, crowd, cells, every)
    return keep(found.distinct(), "line-every") if every else found


def _linked(lines: DataFrame, tau: int, crowd: int, cells: int, every: bool) -> DataFrame:
    alone = F.col("id").alias("kind")
    lines = lines.withColumn("sig", F.expr(SIGNATURE))
    found, resolved, crowded = _meet(segment_keys(lines, tau).select("*", alone), lines, tau, crowd, None, every)
    if crowded is None:
        return found
    n_parts = partitions(lines.sparkSession)
    members = keep(lines.join(crowded.select("id").distinct(), "id", "left_semi"), "line-members")
    spread = members.repartition(n_parts)  # a few lines have many keys
    # tau edits touch fewer cells than tau, or as many with one edit each
    rows = None
    for touched in range(1, tau):
        some = cell_keys(spread, tau, cells, touched).select("key", "id", "sig", "own", alone)
        rows = some if rows is None else rows.unionByName(some)
    single = keep(cell_keys(spread, tau, cells, tau), "line-cells")
    counts = single.groupBy(F.col("key").alias("met")).agg(F.count(F.lit(1)).alias("c"), F.max("own").alias("own")).where("own AND c > 1")
    counts = keep(counts, "line-counts")
    single = single.join(small(counts.select("met", "c"), counts.count(), BROADCAST_ROWS), F.col("key") == F.col("met"))
    more = single.where(F.col("c") <= crowd).select("key", "id", "sig", "own", alone).unionByName(variant_keys(single.where(F.col("c") > crowd), members, cells))
    links, resolved, crowded = _meet(more if rows is None else rows.unionByName(more), members, tau, crowd, resolved, every)
    found = found.unionByName(links)
    if crowded is None:
        return found
    # lines that agree but for one cell: the unresolved ones meet all earlier ones of their key (the earliest they have met)
    rest = crowded.select("key", F.col("id").alias("early"), "kind", "lo", "sig").join(crowded.where("late").select("key", F.col("id").alias("late"), F.col("kind").alias("other"), F.col("sig").alias("sig2")), "key")
    rest = rest.where("early < late AND kind <> other" if every else "early < late AND early <> lo AND kind <> other").where(_similar(tau)).select("early", "late").distinct()
    return found.unionByName(keep(verified(rest, members, tau), "line-links"))


# --- what goes


def marks(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, classes: bool = False, **parameters) -> DataFrame:
    """doc_id, t, n_lines, drops (line numbers from 0), n_equal, n_near of documents that lose lines.  With ``classes`` also
    classes (the documents of the lines that stand for them) and, of all documents with a linked line, n_links (the other
    lines that its distinct lines are linked to) and linked (the documents of the lines that stand for these); docs: doc_id, text."""
    docs = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    table = line_table(docs, tau, min_chars)
    lines = partners(docs, table)
    links = linked(lines, tau, every=classes, **parameters)
    if classes:
        ends = links.select(F.col("late").alias("id"), F.lit(True).alias("near")).unionByName(links.select(F.col("early").alias("id"), F.lit(False).alias("near")))
        near = ends.groupBy("id").agg(F.max("near").alias("near"), F.count(F.lit(1)).alias("n_links"))
        roots = components(links.select(F.col("late").alias("a"), F.col("early").alias("b")))
        near = near.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        near = near.join(lines.select(F.col("id").alias("root"), F.col("doc_id").alias("class")), "root")
    else:
        near = links.select(F.col("late").alias("id")).distinct().select("id", F.lit(True).alias("near"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("class"))
    near = near.join(lines.select("id", "h", "h2"), "id").select("h", "h2", "near", "n_links", "class")
    equal = table.groupBy("h", "h2").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    marked = equal.join(near, ["h", "h2"], "full_outer").select(F.col("h").alias("mh"), F.col("h2").alias("mh2"), "first_id", F.coalesce("near", F.lit(False)).alias("near"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("class", "first_id").alias("class"))
    marked = keep(marked, "line-marks")
    same = (F.col("h") == F.col("mh")) & (F.col("h2") == F.col("mh2"))
    seen = table.select("doc_id", "t", "pos", "h", "h2").join(small(marked, marked.count(), BROADCAST_ROWS), same).select("doc_id", "t", "pos", "h", "h2", "near", "n_links", "class", (F.col("doc_id") > F.col("first_id")).alias("later"))
    # in the document that holds a line first, its first place stays
    order = Window.partitionBy("doc_id", "h", "h2").orderBy("t", "pos")
    inside = seen.where("NOT near AND NOT later").withColumn("first", F.rank().over(order) == 1).where("NOT first").drop("first")
    gone = seen.where("near OR later").unionByName(inside).select("doc_id", "t", "pos", "near", "class").distinct()
    by_doc = gone.groupBy("doc_id", "t").agg(F.collect_list("pos").alias("drops"), F.count_if("near").alias("n_near"), F.count_if(~F.col("near")).alias("n_equal"), F.array_sort(F.collect_set("class")).alias("classes"))
    if not classes:
        return by_doc.drop("classes")
    held = seen.where("n_links > 0").select("doc_id", "t", "h", "h2", "n_links", "class").distinct()
    held = held.groupBy("doc_id", "t").agg(F.sum("n_links").alias("n_links"), F.array_sort(F.collect_set("class")).alias("linked"))
    return by_doc.join(held, ["doc_id", "t"], "full_outer")


def marked_documents(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, classes: bool = False, **parameters) -> DataFrame:
    """``docs`` with __drops, __near, __equal, __kept_text, and with ``classes`` __classes, __links and __linked."""
    found = marks(docs, tau, min_chars, classes, **parameters)
    found = keep(found.select(F.col("doc_id").alias("__id"), F.col("t").alias("__t"), F.col("drops").alias("__drops"), F.col("n_near").alias("__near"), F.col("n_equal").alias("__equal"), *[F.col(c).alias(f"__{a}") for c, a in [("classes", "classes"), ("n_links", "links"), ("linked", "linked")] if classes]), "line-drops")
    size = found.agg(F.sum(F.coalesce(F.size("__drops"), F.lit(0)) + 4)).first()[0] or 0
    joined = docs.join(small(found, size, 10 * BROADCAST_ROWS), (docs["doc_id"] == found["__id"]) & (F.xxhash64(docs["text"]) == found["__t"]), "left").drop("__id", "__t")
    # the text is split once, and each line looked up by its number
    rest = F.expr("transform(array(split(text, '\\n')), ls -> array_join(transform(array_except(sequence(0, size(ls) - 1), __drops), i -> ls[i]), '\\n'))[0]")
    return joined.withColumn("__kept_text", F.when(F.col("__drops").isNotNull(), rest).otherwise(F.col("text")))


def drop_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, **parameters) -> DataFrame:
    """``docs`` without the dropped lines, same columns (n_chars follows the text); documents that keep nothing but blank lines go."""
    found = marked_documents(docs, tau, min_chars, **parameters)
    lost = F.col("__drops").isNotNull() & _blank("__kept_text")
    found = found.where(~F.coalesce(lost, F.lit(False)))
    new = {"text": F.col("__kept_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("__drops").isNotNull(), F.char_length("__kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    """One row a document: lines, lines dropped as equal to or near an earlier one, the documents that hold the lines of
    their classes, the digest of the text that stays, the links of its distinct lines to other lines, dropped or not, and the
    documents that hold the earliest lines of the linked ones' classes."""
    found = marked_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), classes=True)
    count = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return found.select(
        "doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"), count("__equal").alias("n_equal"), count("__near").alias("n_near"),
        F.coalesce("__classes", F.array().cast("array<bigint>")).alias("class_ids"), F.sha2(F.coalesce("__kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
        count("__links").alias("n_links"), F.coalesce("__linked", F.array().cast("array<bigint>")).alias("link_class_ids"),
    )


QUERIES = {"op2_line_dedup": op2_line_dedup}
SQL: dict[str, str] = {}
