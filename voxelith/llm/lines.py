"""Line deduplication within an edit distance; DataFrame functions only.

Lines are what newlines separate; those of at least `exact_from` code points (`shortest`, if it is not given) take part, shorter ones always
stay. A line stays if it is the first occurrence of its text, by (id, hash of the document's text, position), and no line with an earlier
first occurrence is within `threshold` edits of it; lines of less than `shortest` code points are compared with equal ones only.

Two lines within the threshold share a segment: of threshold + 1 disjoint segments of the shorter one, some segment (say number i) stands
unchanged in the other line, with at most i edits before it and threshold - i after it, so it is shifted by no more than these,
counted from the nearer end. Segments are index keys together with their number and a rounded length (an eighth of a power of two), from which
their places follow; a line is looked up with its substrings at the allowed places, for its own rounded length and those that its length less
the threshold may have. Only one row of each different line takes part in all this.

In each key every line is compared with the key's earliest line. Lines that this decides need no comparison of their own. The others
are compared with earlier lines of the key, but not with all of them: lines are placed by where they first and last differ from the key's
earliest line (`placed_by`), two lines within the threshold of each other lie in overlapping spans on both sides, and only
lines whose spans meet are paired, by an equi-join on the span's blocks. As each edit takes one code point away, adds one, or both, lines within the
threshold have all counts of code points in common but those of 2 * threshold classes: of 2 * threshold + 1 groups of classes one has equal counts, which
are a further part of the join's key (`counted`), and the counts together differ by no more than `threshold` either way (`alike`). The check of a pair is a
bit-parallel edit distance in a band of 2 * threshold + 1 diagonals.

Null texts stay null, empty texts empty, empty tables empty. Very long lines are taken whole. Rows equal in id and text are judged alike.
Null ids come first. Ties (equal lines) go to the first occurrence. Other columns stay, whatever they are called, but those named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, free_name, saved

LINE = "\n"
#: Code points of a span's block, for each edit of the threshold.
BLOCK = 8
#: Classes of code points counted in one number, and the bits of each count.
SLOTS, BITS = 3, 16


def rounded(n: Column) -> Column:
    """n rounded down to an eighth of its power of two."""
    step = F.call_function("shiftleft", F.lit(1), F.greatest(F.length(F.bin(n)) - 4, F.lit(0)))
    return n - n % step


def looks(threshold: int) -> list[tuple[int, int, int, int, bool]]:
    """Where lines are looked at: (shorter, number, segments, shift, from_end).

    For a rounded length that a line `shorter` code points shorter has, at so many segments and a shift from the start, or before the end. Those with neither
    are the line's own segments, which are index keys; the others are probes for lines of the same or a lesser length.
    """
    out = []
    for shorter in range(threshold + 1):
        for i in range(threshold + 1):
            left, right = i, threshold - i
            for shift in range(-min(left, right), min(left, right) + 1):
                out.append((shorter, i, i if left <= right else right + 1, shift, left > right))
    return out


def keys(lines: DataFrame, threshold: int) -> DataFrame:
    """(key, own, h1) of each place at which each line (h1, line) is looked at."""
    n = F.length("line")
    bases = [rounded(F.greatest(n - j, F.lit(1))) for j in range(threshold + 1)]
    # a lesser length counts only where it rounds to another base than the one before
    used = [bases[0]] + [F.when((n > j) & (bases[j] != bases[j - 1]), bases[j]).otherwise(F.lit(0)) for j in range(1, threshold + 1)]
    sized = lines.select("h1", "line", n.alias("n"), *[u.alias(f"base{j}") for j, u in enumerate(used)])
    structs = F.array(*[F.struct(*[F.lit(v).alias(name) for v, name in zip(x, ("shorter", "number", "segments", "shift", "end"))]) for x in looks(threshold)])
    each = sized.withColumn("look", F.explode(structs))
    base = F.col("base0")
    for j in range(1, threshold + 1):
        base = F.when(F.col("look.shorter") == j, F.col(f"base{j}")).otherwise(base)
    size = F.floor(base / (threshold + 1)).cast("int")
    each = each.withColumns({"base": base, "size": size}).where("size > 0")
    at = F.when(F.col("look.end"), F.col("n") - F.col("look.segments") * F.col("size")).otherwise(F.col("look.segments") * F.col("size")) + F.col("look.shift")
    each = each.withColumn("at", at).where("at >= 0 and at + size <= n")
    own = (F.col("look.shorter") == 0) & (F.col("look.shift") == 0)
    return each.select(F.xxhash64("base", "look.number", F.substring("line", F.col("at") + 1, F.col("size"))).alias("key"), own.alias("own"), "h1")


def bound(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def common_start(x: Column, y: Column) -> Column:
    """How many code points two texts have in common at their beginning."""
    least = F.least(F.length(x), F.length(y))
    powers = F.transform(F.sequence(F.length(F.bin(least)), F.lit(0), F.lit(-1)), lambda e: F.call_function("shiftleft", F.lit(1), e))
    return F.aggregate(powers, F.lit(0), lambda at, p2: F.when((at + p2 <= least) & (F.substring(x, at + 1, p2) == F.substring(y, at + 1, p2)), at + p2).otherwise(at))


def within(a: Column, b: Column, threshold: int) -> Column:
    """Whether the edit distance of two texts is at most threshold (30 at most).

    What both begin and end with is cut off first. Texts that the threshold could delete whole get an equal end, which changes no distance. Then one column of the band after another; bit r of column j stands for row
    j - threshold + r. The distance is followed down the lowest diagonal, where it never falls, then along the last row; once it
    is too large to come down again, the columns that are left are passed over.
    """
    if not 0 <= threshold <= 30:
        raise ValueError("the band has to fit into 62 bits")
    k, width = threshold, 2 * threshold + 1
    long = lambda x: F.lit(x).cast("long")
    mask = long((1 << width) - 1)

    def matches(t: Column, j: Column) -> Column:
        def of(own: Column) -> Column:
            # get() gives null for rows outside the text, which match nothing
            bits = [F.when(F.get(t["a"], j - (k + 1 - r)) == own, long(1 << r)).otherwise(long(0)) for r in range(width)]
            total = bits[0]
            for x in bits[1:]:
                total = total.bitwiseOR(x)
            return total

        return bound(F.get(t["b"], j - 1), of)

    def column(t: Column, s: Column, j: Column) -> Column:
        vp, vn, m = s["vp"], s["vn"], t["m"]

        def moved(d0: Column, hp: Column, hn: Column) -> Column:
            down = F.shiftrightunsigned(d0, 1)
            row = F.greatest(m - j + k, F.lit(0))
            along = F.when(j <= m - k, 1 - F.getbit(d0, F.lit(2 * k)).cast("int")).otherwise(F.getbit(hp, row).cast("int") - F.getbit(hn, row).cast("int"))
            return F.struct(hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp))).bitwiseAND(mask).alias("vp"), down.bitwiseAND(hp).alias("vn"), (s["d"] + along).alias("d"))

        kept = lambda pm: ((pm.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(pm).bitwiseOR(vn).bitwiseAND(mask)
        return bound(matches(t, j), lambda pm: bound(kept(pm), lambda d0: bound(vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))).bitwiseAND(mask), lambda hp: moved(d0, hp, d0.bitwiseAND(vp)))))

    start = F.struct(long(((1 << width) - 1) ^ ((1 << k) - 1)).alias("vp"), long(0).alias("vn"), F.lit(k).alias("d"))

    def walked(t: Column) -> Column:
        most = 2 * k + t["n"] - t["m"]
        columns = F.when(t["n"] > 0, F.sequence(F.lit(1), t["n"])).otherwise(F.array().cast("array<int>"))
        return F.aggregate(columns, start, lambda s, j: F.when(s["d"] > most, s).otherwise(column(t, s, j)), lambda s: s["d"])

    def banded(p: Column) -> Column:
        """p: the two texts without common ends."""
        x, y = p["a"], p["b"]
        full = F.struct(F.split(x, "").alias("a"), F.split(y, "").alias("b"), F.length(x).alias("m"), F.length(y).alias("n"))
        # what the threshold could delete whole is longer than any pair within it allows, or gets an equal end that fills the band
        filler = "\u0001" * (k + 1)
        padded = F.struct(F.split(F.concat(x, F.lit(filler)), "").alias("a"), F.split(F.concat(y, F.lit(filler)), "").alias("b"), (F.length(x) + k + 1).alias("m"), (F.length(y) + k + 1).alias("n"))
        return bound(F.when(F.least(F.length(x), F.length(y)) <= k, padded).otherwise(full), walked) <= k

    def without_prefix(p: Column) -> Column:
        """Both texts, reversed, without their longest common beginning."""
        x, y = p["a"], p["b"]
        return bound(common_start(x, y), lambda n: F.struct(F.reverse(F.substring(x, n + 1, F.length(x))).alias("a"), F.reverse(F.substring(y, n + 1, F.length(y))).alias("b")))

    both = F.struct(a.alias("a"), b.alias("b"))
    near = bound(both, lambda p: bound(without_prefix(p), lambda q: bound(without_prefix(q), banded)))
    return F.when(F.abs(F.length(a) - F.length(b)) > threshold, F.lit(False)).when(a == b, F.lit(True)).otherwise(near)


def _lines(df: DataFrame, id_col: str, text_col: str, exact_from: int) -> DataFrame:
    """(id, text_key, pos, line, h1, h2) of each line that takes part."""
    text = F.col(text_col).cast("string")
    each = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), F.posexplode(F.split(text, LINE)).alias("pos", "line")).where(F.length("line") >= exact_from)
    return each.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), F.col("line"))})


def placed_by(x: Column, head: Column, threshold: int) -> Column:
    """Where x differs from another text: struct (from_start, start_to, from_end, end_to).

    from_start code points are common to both beginnings. Where the next BLOCK * threshold ones are more than 2 * threshold edits apart, no text
    within the threshold of x can have more than start_to code points in common with the beginning of head: of x against such a beginning
    there would be at most `threshold` edits, and twice as many at most for pieces of equal length. (Nor can it where head ends before.) Where they
    are nearer, start_to is unbounded. The same holds from the ends.
    """
    window = BLOCK * max(threshold, 1)

    def side(a: Column, b: Column) -> Column:
        def span(n: Column) -> Column:
            p, q = F.substring(a, n + 1, F.lit(window)), F.substring(b, n + 1, F.lit(window))
            apart = (F.length(b) < n + window) | ~within(p, q, 2 * threshold)
            return F.struct(n.alias("at"), F.when(apart, n + window - 1).otherwise(F.lit((1 << 31) - 1)).alias("to"))

        return bound(common_start(a, b), span)

    return bound(
        F.struct(side(x, head).alias("s"), side(F.reverse(x), F.reverse(head)).alias("e")),
        lambda t: F.struct(t["s"]["at"].alias("from_start"), t["s"]["to"].alias("start_to"), t["e"]["at"].alias("from_end"), t["e"]["to"].alias("end_to")),
    )


def counted(line: Column, threshold: int) -> list[Column]:
    """How many code points of each class a line has: one number for each of 2 * threshold + 1 groups of SLOTS classes.

    Counts overflow into the next one; as sums modulo a power of two, the numbers differ by what the edits change all the same.
    """
    groups, mask = 2 * threshold + 1, F.lit((1 << SLOTS * BITS) - 1).cast("long")
    zero = F.lit(0).cast("long")
    one = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.floor(x / groups).cast("int") % SLOTS * BITS)
    codes = F.transform(F.split(line, ""), lambda x: F.ascii(x))
    of = lambda g: F.filter(codes, lambda x: x % groups == g)
    return [F.aggregate(of(g), zero, lambda s, x: (s + one(x)).bitwiseAND(mask)) for g in range(groups)]


def alike(a: list[Column], b: list[Column], n_a: Column, n_b: Column, threshold: int) -> Column:
    """Whether two lines' counts differ by no more than threshold edits can change: so many code points too many, and so many too few."""
    mask, middle = (1 << SLOTS * BITS) - 1, sum(threshold << BITS * i for i in range(SLOTS))
    more = F.lit(0).cast("long")
    for x, y in zip(a, b):
        apart = (x - y + F.lit(middle)).bitwiseAND(F.lit(mask).cast("long"))
        for i in range(SLOTS):
            more = more + F.greatest(F.shiftright(apart, BITS * i).bitwiseAND(F.lit((1 << BITS) - 1).cast("long")) - threshold, F.lit(0).cast("long"))
    return (more <= threshold) & (more - (n_a - n_b) <= threshold)


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a1, a2, b1, b2) with line_a and line_b."""
    for side in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("h1").alias(f"{side}1"), F.col("h2").alias(f"{side}2"), F.col("line").alias(f"line_{side}")), [f"{side}1", f"{side}2"])
    return pairs


def paired(around: DataFrame, sums: list[str], threshold: int) -> DataFrame:
    """Each pair of lines a, b of a key of which b, the later one, may be within the threshold of a, by their spans and counts."""
    names = ["own", "first", "h1", "h2", "n", "from_start", "start_to", "from_end", "end_to", *sums]
    each = around.select("*", F.posexplode(F.array(*sums)).alias("group", "equal"))
    on = ["key", "block", "group", "equal"]
    a = each.select(*on, *[F.col(c).alias(f"{c}_a") for c in names])
    b = each.where("not late").select(*on, *[F.col(c).alias(f"{c}_b") for c in names])
    meet = (F.col("from_start_a") <= F.col("start_to_b")) & (F.col("from_start_b") <= F.col("start_to_a")) & (F.col("from_end_a") <= F.col("end_to_b")) & (F.col("from_end_b") <= F.col("end_to_a"))
    able = (F.col("first_a") < F.col("first_b")) & (F.col("own_a") | F.col("own_b")) & (F.abs(F.col("n_a") - F.col("n_b")) <= threshold)
    # two spans meet in several blocks, and several groups may have equal counts; the first of them counts
    once = F.col("block") == F.floor(F.greatest("from_start_a", "from_start_b") / (BLOCK * max(threshold, 1)))
    for g, c in enumerate(sums):
        once = once & ((F.col("group") <= g) | (F.col(f"{c}_a") != F.col(f"{c}_b")))
    near = alike([F.col(f"{c}_a") for c in sums], [F.col(f"{c}_b") for c in sums], F.col("n_a"), F.col("n_b"), threshold)
    return b.join(a, on).where(able & meet & once & near)


def first_lines(df: DataFrame, id_col: str, text_col: str, threshold: int, shortest: int, exact_from: int) -> DataFrame:
    """(id, text_key, pos) of the lines that take part and stay."""
    lines = _lines(df, id_col, text_col, exact_from)
    # one row of each different line, with its text: everything else starts from here
    one = F.min(F.struct("id", "text_key", "pos", "line")).alias("first")
    distinct = saved(lines.groupBy("h1", "h2").agg(one).select("h1", "h2", F.struct("first.id", "first.text_key", "first.pos").alias("first"), "first.line"), "zstd")
    firsts = distinct.select("h1", "h2", "first")
    if not threshold:
        return firsts.select("first.id", "first.text_key", "first.pos")
    keyed = keys(distinct.where(F.length("line") >= shortest), threshold)
    # own rows count 2**32, so that one short sum tells both how many rows and whether a segment is among them
    weight = F.when(F.col("own"), F.lit((1 << 32) + 1)).otherwise(F.lit(1)).cast("long")
    shared = keyed.groupBy("key").agg(F.sum(weight).alias("rows")).where(((F.col("rows") % (1 << 32)) > 1) & (F.col("rows") >= 1 << 32)).select("key")
    # written between the join and the aggregate, so that a hot key's part of the join can be split
    matched = saved(keyed.join(shared, "key"))
    texts = saved(distinct.join(matched.select("h1").distinct(), "h1", "left_semi").select("h1", "h2", "first", "line"))

    members = matched.groupBy("key", "h1").agg(F.max("own").alias("own"))
    placed = saved(members.join(texts.select("h1", "h2", "first", F.length("line").alias("n")), "h1").select("key", "own", "first", "h1", "h2", "n"))
    head = F.min(F.struct("first", F.col("h1").alias("a1"), F.col("h2").alias("a2"))).alias("head")
    heads = saved(placed.groupBy("key").agg(head, F.count(F.lit(1)).alias("rows")).where("rows > 1").select("key", "head.a1", "head.a2"))
    stars = placed.join(heads, "key").where("h1 <> a1 or h2 <> a2").select("a1", "a2", F.col("h1").alias("b1"), F.col("h2").alias("b2")).distinct()
    spans = placed_by(F.col("line_b"), F.col("line_a"), threshold)
    compared = _with_texts(stars, texts).select("a1", "a2", F.col("b1").alias("h1"), F.col("b2").alias("h2"), within(F.col("line_a"), F.col("line_b"), threshold).alias("near"), spans.alias("span"))
    compared = saved(compared)
    late = compared.where("near").select("h1", "h2").distinct()

    # only keys with lines that no comparison with their earliest one decided
    around = placed.join(heads, "key").join(compared, ["a1", "a2", "h1", "h2"]).join(late.withColumn("late", F.lit(True)), ["h1", "h2"], "left")
    around = saved(around.select("key", "own", "first", "h1", "h2", "n", F.coalesce("late", F.lit(False)).alias("late"), "span.*"))
    open_keys = around.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("late").alias("late")).where("rows > 1 and not late").select("key")
    block = BLOCK * max(threshold, 1)
    blocks = F.sequence(F.floor(F.col("from_start") / block), F.floor(F.least(F.col("start_to"), F.col("n") + threshold) / block))
    around = around.join(open_keys, "key")
    sums = [f"sum{g}" for g in range(2 * threshold + 1)]
    counts = texts.join(around.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select("h1", "h2", *[x.alias(c) for x, c in zip(counted(F.col("line"), threshold), sums)])
    around = saved(around.join(counts, ["h1", "h2"]).withColumn("block", F.explode(blocks)))
    rest = paired(around, sums, threshold).select(F.col("h1_a").alias("a1"), F.col("h2_a").alias("a2"), F.col("h1_b").alias("b1"), F.col("h2_b").alias("b2")).distinct()
    more = saved(_with_texts(rest, texts).where(within(F.col("line_a"), F.col("line_b"), threshold)).select(F.col("b1").alias("h1"), F.col("b2").alias("h2")).distinct())
    return firsts.join(late.unionByName(more), ["h1", "h2"], "left_anti").select("first.id", "first.text_key", "first.pos")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2, shortest: int = 20, lines_col: str = "n_lines", removed_col: str = "n_removed", exact_from: int | None = None) -> DataFrame:
    """df with the text that its lines leave, the number of lines before and of those removed; columns of these names are replaced."""
    if shortest <= threshold:
        raise ValueError("lines have to be longer than the threshold")
    exact_from = shortest if exact_from is None else min(exact_from, shortest)
    own = dropped(df, lines_col, removed_col)
    stay = first_lines(own, id_col, text_col, threshold, shortest, exact_from).groupBy("id", "text_key").agg(F.collect_list("pos").alias("stay"))
    key, kept, parts, places, other = (free_name(own, x) for x in ("text_key__", "stay__", "parts__", "places__", "id__"))
    stay = stay.select(F.col("id").alias(other), F.col("text_key").alias(key), F.col("stay").alias(kept))
    text = F.col(text_col).cast("string")
    keyed = own.withColumn("own_" + key, F.xxhash64(text))
    out = keyed.join(stay, keyed[id_col].eqNullSafe(stay[other]) & (keyed["own_" + key] == stay[key]), "left").drop(key, other, "own_" + key)
    out = out.withColumn(parts, F.split(text, LINE))
    spots = F.transform(F.col(parts), lambda p, i: F.when(F.length(p) < exact_from, i))
    free = F.filter(spots, lambda i: i.isNotNull())
    out = out.withColumn(places, F.array_sort(F.array_union(free, F.coalesce(F.col(kept), F.array().cast("array<int>")))))
    whole = F.array_join(F.transform(F.col(places), lambda i: F.get(F.col(parts), i)), LINE)
    n = F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(F.size(parts)).cast("long")
    gone = F.when(n == 0, F.lit(0)).otherwise(n - F.size(places)).cast("long")
    return out.withColumns({lines_col: n, removed_col: gone}).withColumn(text_col, F.when(text.isNull(), text).otherwise(whole)).drop(kept, parts, places)
