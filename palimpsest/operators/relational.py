"""Generic operators on any DataFrame: identification, voting, comparison, set audits, runs, search, chains and trees.

Each takes DataFrames and column names and returns a lazy DataFrame. Aggregations are keyed and
combine before the shuffle; lookup sides are pre-aggregated to one row a key, so joins never
multiply rows; no side is broadcast by hand, Spark decides by size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def identify(probes: DataFrame, dataset: DataFrame, key: str, strong: str, weak: list[str], name: str) -> DataFrame:
    """Probes with class, candidates, those among them that have the probe's strong hash (n_equal) and the first name: unknown, named, duplicated, collision, or unverified.

    dataset entries are candidates where the weak columns agree. One is named, whatever its strong hash; of several, any without one leaves the probe
    unverified, else those with the probe's strong hash decide: none is a collision, one names it, more are duplicated.
    """
    weakly = dataset.groupBy(*weak).agg(F.count("*").alias("n_candidates"), F.count(strong).alias("n_strong"), F.min(name).alias("any_name"))
    strongly = dataset.where(F.col(strong).isNotNull()).groupBy(*weak, strong).agg(F.count("*").alias("n_equal"), F.min(name).alias("equal_name"))
    out = probes.select(key, strong, *weak).join(weakly, weak, "left").join(strongly, [*weak, strong], "left")
    n, equal = F.coalesce("n_candidates", F.lit(0)), F.coalesce("n_equal", F.lit(0))
    kind = F.when(n == 0, "unknown").when(n == 1, "named").when(F.col("n_strong") < n, "unverified").when(equal == 0, "collision").when(equal == 1, "named").otherwise("duplicated")
    return out.select(key, *weak, kind.alias("class"), n.alias("n_candidates"), equal.alias("n_equal"), F.coalesce("equal_name", "any_name").alias("name"))


def vote(ballots: DataFrame, unit: list[str], value: str, source: str) -> DataFrame:
    """Plurality per unit: state (unanimous, resolved, unresolved), the chosen value, sources and distinct values.

    A tied lead takes the value of the smallest source. Counts are combined before each shuffle; a unit's values are never gathered.
    """
    counts = ballots.groupBy(*unit, value).agg(F.count("*").alias("n"), F.min(source).alias("first"))
    ranks = counts.groupBy(*unit, "n").agg(F.count("*").alias("ties"), F.max(value).alias("leader"), F.min_by(F.struct(F.col(value).alias("v")), "first").alias("earliest"), F.min("first").alias("first"))
    best = ranks.groupBy(*unit).agg(
        F.sum(F.col("n") * F.col("ties")).alias("sources"), F.sum("ties").alias("n_values"), F.max_by(F.struct("ties", "leader"), "n").alias("top"), F.min_by("earliest", "first").alias("fallback"),
    )
    alone = F.col("top.ties") == 1
    state = F.when(F.col("n_values") == 1, "unanimous").when(alone, "resolved").otherwise("unresolved")
    return best.select(*unit, "sources", "n_values", state.alias("state"), F.when(alone, F.col("top.leader")).otherwise(F.col("fallback.v")).alias("chosen"))


def diff(left: DataFrame, right: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Full comparison by key: one row for each difference (only_left, only_right, or the column that differs)."""
    a = left.select(*key, F.lit(True).alias("_l"), *[F.col(c).alias(f"_l_{c}") for c in columns])
    b = right.select(*key, F.lit(True).alias("_r"), *[F.col(c).alias(f"_r_{c}") for c in columns])
    joined = a.join(b, key, "full")
    kinds = F.when(F.col("_r").isNull(), F.array(F.lit("only_left"))).when(F.col("_l").isNull(), F.array(F.lit("only_right")))
    kinds = kinds.otherwise(F.filter(F.array(*[F.when(~F.col(f"_l_{c}").eqNullSafe(F.col(f"_r_{c}")), F.lit(c)) for c in columns]), lambda x: x.isNotNull()))
    return joined.select(*key, F.explode(kinds).alias("difference"))


def set_audit(claimed: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: orphaned (claimed, not found) and at_risk (found, not claimed)."""
    a, b = claimed.select(key).distinct(), found.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("state", F.lit("orphaned")).unionByName(b.join(a, key, "left_anti").withColumn("state", F.lit("at_risk")))


def islands(df: DataFrame, partition: list[str], order: list[str], same: list[str], step: str | None = None) -> DataFrame:
    """Runs of neighbouring rows with equal `same` columns (and, with step, that column rising by one): partition, same, first, last, rows."""
    if step and order == [step]:
        return _stepped(df, partition, same, step)
    w = Window.partitionBy(*partition).orderBy(*order)
    new = F.lit(False)
    for c in same:
        new = new | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    if step:
        new = new | ~F.coalesce(F.col(step) == F.lag(step).over(w) + 1, F.lit(False))
    marked = df.withColumn("_new", (new | (F.row_number().over(w) == 1)).cast("int"))
    numbered = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    by = step or order[-1]
    return numbered.groupBy(*dict.fromkeys([*partition, "_run", *same])).agg(F.min(by).alias("first"), F.max(by).alias("last"), F.count("*").alias("rows")).drop("_run")


#: Numbers in a row that one window of a stepped run looks at.
STRETCH = 1 << 16


def _stepped(df: DataFrame, partition: list[str], same: list[str], step: str) -> DataFrame:
    """Runs of a column rising by one. Stretches of STRETCH numbers are windows of their own, so a partition of any size is spread; runs that
    touch a stretch's ends, two a stretch at most, are then joined up."""
    cut = df.withColumn("_cut", F.floor(F.col(step) / STRETCH).cast("bigint"))
    w = Window.partitionBy(*partition, "_cut").orderBy(step)
    new = ~F.coalesce(F.col(step) == F.lag(step).over(w) + 1, F.lit(False))
    for c in same:
        new = new | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    numbered = cut.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    numbered = numbered.withColumn("_runs", F.max("_run").over(Window.partitionBy(*partition, "_cut")))
    keys = list(dict.fromkeys([*partition, *same]))
    runs = numbered.groupBy(*keys, "_cut", "_run", "_runs").agg(F.min(step).alias("first"), F.max(step).alias("last"), F.count("*").alias("rows"))
    begins = (F.col("_run") == 1) & (F.col("first") == F.col("_cut") * STRETCH)
    ends = (F.col("_run") == F.col("_runs")) & (F.col("last") == (F.col("_cut") + 1) * STRETCH - 1)
    runs = runs.withColumn("_begins", F.coalesce(begins, F.lit(False))).withColumn("_ends", F.coalesce(ends, F.lit(False)))
    inner = runs.where("not _begins and not _ends").select(*keys, "first", "last", "rows")
    v = Window.partitionBy(*partition).orderBy("_cut", "_run")
    follows = F.col("_begins") & F.lag("_ends").over(v) & (F.lag("_cut").over(v) == F.col("_cut") - 1)
    for c in same:
        follows = follows & F.col(c).eqNullSafe(F.lag(c).over(v))
    edge = runs.where("_begins or _ends").withColumn("_new", (~F.coalesce(follows, F.lit(False))).cast("int"))
    edge = edge.withColumn("_group", F.sum("_new").over(v.rowsBetween(Window.unboundedPreceding, 0)))
    joined = edge.groupBy(*keys, "_group").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("rows").alias("rows")).drop("_group")
    return inner.unionByName(joined)


def overlapping(text: Column, needle: str, ignore_case: bool = False) -> Column:
    """0-based positions of all occurrences, overlapping ones included; in one pass over the text, which is cut before each occurrence."""
    wanted = f"{'(?i)' if ignore_case else ''}(?=\\Q{needle.replace(chr(92) + 'E', chr(92) + 'E' + chr(92) * 2 + 'E' + chr(92) + 'Q')}\\E)"
    sizes = F.transform(F.split(text, wanted), F.length)
    start = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("now"))
    cuts = F.aggregate(sizes, start, lambda s, n: F.struct(F.concat(s["at"], F.array(s["now"] + n)).alias("at"), (s["now"] + n).alias("now")))["at"]
    whole, begin = (F.lower(text), needle.lower()) if ignore_case else (text, needle)
    first = F.when(F.startswith(whole, F.lit(begin)), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return F.concat(first, F.slice(cuts, 1, F.size(cuts) - 1))


def find(df: DataFrame, key: str, text: str, needle: str, block: int = 512, ignore_case: bool = False) -> DataFrame:
    """One row for each occurrence: key, at, and the block it begins in. Case is ignored as the lower case of letters tells."""
    if not needle:
        raise ValueError("an empty pattern")
    there = F.contains(F.lower(text), F.lit(needle.lower())) if ignore_case else F.contains(text, F.lit(needle))
    hits = df.where(there).select(key, F.explode(overlapping(F.col(text), needle, ignore_case)).alias("at"))
    return hits.select(key, F.col("at").cast("bigint").alias("at"), F.floor(F.col("at") / block).cast("bigint").alias("block"))


def attribute(hits: DataFrame, owners: DataFrame, on: list[str], region: str = "region") -> DataFrame:
    """Hits with their owner's columns; region is unclaimed where there is none."""
    return hits.join(owners, on, "left").withColumn(region, F.coalesce(region, F.lit("unclaimed")))


def first_owner(df: DataFrame, shared: str, owner: str, order: list[str]) -> DataFrame:
    """Rows of `shared` values with several owners, past the first owner's: with the first owner's name."""
    firsts = df.groupBy(shared).agg(F.min_by(owner, F.struct(*order)).alias("first_owner"), F.count_distinct(owner).alias("owners"))
    return df.join(firsts.where("owners > 1"), shared).where(~F.col(owner).eqNullSafe(F.col("first_owner")))


def most_specific(hits: DataFrame, at: list[str], length: str, name: str) -> DataFrame:
    """Of several names at one place, the longest (then the first by name)."""
    return hits.groupBy(*at).agg(F.min_by(F.struct(name, length), F.struct(-F.col(length), F.col(name))).alias("_b")).select(*at, "_b.*")


def scan_prefixes(df: DataFrame, key: str, text: str, signatures: DataFrame) -> DataFrame:
    """Signatures (name, magic) whose magic begins the text, however many there are: beginnings of each length that a magic has are joined by equality."""
    wanted = signatures.select("name", "magic", F.length("magic").alias("magic_length")).where("magic_length > 0")
    lengths = sorted(r[0] for r in wanted.select("magic_length").distinct().collect())  # as many as the longest magic has letters
    begins = F.explode(F.array(*[F.substring(text, 1, n) for n in lengths])) if lengths else F.lit(None).cast("string")
    return df.select(key, begins.alias("magic")).distinct().join(wanted, "magic").select(key, "name", "magic_length")


def top_and_rest(df: DataFrame, group: list[str], order: list[str], keep: int, label: str) -> DataFrame:
    """The first rows of each group, and one row that counts the others."""
    w = Window.partitionBy(*group).orderBy(*order)
    ranked = df.withColumn("_n", F.row_number().over(w))
    kept = ranked.where(F.col("_n") <= keep).select(*group, F.col("_n").cast("bigint").alias("rank"), F.col(label).cast("string").alias("item"), F.lit(1).cast("bigint").alias("rows"))
    rest = df.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") > keep).select(*group, F.lit(keep + 1).cast("bigint").alias("rank"), F.lit("more").alias("item"), (F.col("n") - keep).alias("rows"))
    return kept.unionByName(rest)


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """Left rows with the last right value at or before them in their group: one union, one sort, no pairs."""
    a = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType))
    b = right.select(*by, at, F.lit(0).alias("_side"), F.col(value).alias("_v"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(f"last_{value}", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_v")


def in_ranges(df: DataFrame, at: str, ranges: DataFrame, low: str, high: str, name: str) -> DataFrame:
    """Rows with the name of each half-open range around them, one row a range; without any, one row with null.

    at, low and high are whole numbers. A range of 2**k numbers or fewer (and more than half) lies in one or two cells of 2**k; a place is looked up in its cell of each k
    that occurs, so the join is by equality however many ranges there are, and places are joined once each.
    """
    k = F.ceil(F.log2(F.greatest(F.col(high) - F.col(low), F.lit(1)).cast("double"))).cast("int")
    spans = ranges.where(F.col(high) > F.col(low)).select(F.col(low).cast("bigint").alias("_low"), F.col(high).cast("bigint").alias("_high"), F.col(name).alias(name), k.alias("_k"))
    cell = lambda x: F.floor(x / F.pow(F.lit(2.0), F.col("_k"))).cast("bigint")
    cells = spans.withColumn("_cell", F.explode(F.sequence(cell(F.col("_low")), cell(F.col("_high") - 1))))
    sizes = sorted(r[0] for r in spans.select("_k").distinct().collect())  # at most 64
    places = df.select(F.col(at).alias("_at")).where("_at is not null").distinct()
    looked = places.withColumn("_k", F.explode(F.array(*[F.lit(i) for i in sizes]).cast("array<int>"))).withColumn("_cell", cell(F.col("_at")))
    hits = looked.join(cells, ["_k", "_cell"]).where((F.col("_at") >= F.col("_low")) & (F.col("_at") < F.col("_high"))).select("_at", name)
    return df.join(hits, F.col(at) == F.col("_at"), "left").drop("_at")


def walk(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes reached from the roots over edges (parent, child): node, depth, path; a cycle ends where it meets its own path.

    Rounds of joins, each written before the next one, until nothing new is reached: paths don't repeat a node, so no limit on their depth is needed.
    """
    from palimpsest.operators.steps import materialise

    edges = edges.select(F.col("parent").alias("_p"), F.col("child").alias("_c"))
    front = materialise(roots.select("node", F.lit(0).alias("depth"), F.array("node").alias("path")), "walk")
    out = front
    while not front.isEmpty():
        further = front.join(edges, F.col("node") == F.col("_p")).where(~F.array_contains("path", F.col("_c")))
        front = materialise(further.select(F.col("_c").alias("node"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("_c")).alias("path")), "walk")
        out = out.unionByName(front)
    return out


def reach(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes reached from the roots, each once, with the fewest steps: for graphs whose paths are too many to tell."""
    from palimpsest.operators.steps import materialise

    edges = edges.select(F.col("parent").alias("_p"), F.col("child").alias("_c")).distinct()
    seen = front = materialise(roots.select("node").distinct().withColumn("depth", F.lit(0)), "reach")
    while not front.isEmpty():
        further = front.join(edges, F.col("node") == F.col("_p")).select(F.col("_c").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
        front = materialise(further.join(seen, "node", "left_anti"), "reach")
        seen = seen.unionByName(front)
    return seen
