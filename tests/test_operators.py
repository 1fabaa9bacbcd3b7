from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import functions as F
from pyspark.sql import types as T

from auctionlake.functions.text import address_key
from auctionlake.operators import merge as M
from auctionlake.operators import relational as R
from auctionlake.operators.fuzzy import best_matches
from auctionlake.operators.spatial import knn_within
from auctionlake.plans.common import read
from auctionlake.streaming import incremental


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_merge_is_idempotent_and_null_safe(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (None, "n", None)], "k int, s string, v double")
    new = spark.createDataFrame([(1, None, 3.0), (2, "b", None), (None, "m", 2.0)], "k int, s string, v double")
    rules = {"s": "prefer_new", "v": "greatest"}
    once = M.merge_upsert(old, new, ["k"], rules)
    assert rows(once) == sorted([(1, "a", 3.0), (2, "b", None), (None, "m", 2.0)], key=str)
    assert rows(M.merge_upsert(once, new, ["k"], rules)) == rows(once)


def test_append_new_twice_adds_nothing(spark):
    old = spark.createDataFrame([(1, None)], "k int, d string")
    new = spark.createDataFrame([(1, None), (1, "x"), (1, "x")], "k int, d string")
    first = M.append_new(old, new, ["k", "d"])
    assert rows(first) == [(1, "x")]
    assert M.append_new(old.union(first), new, ["k", "d"]).count() == 0


def test_accepted_and_rejects_are_all(spark):
    d = spark.range(100)
    good, bad = M.split_rejects(d, [(F.col("id") < 10, "low"), (F.col("id") % 2 == 0, "even")])
    assert good.count() + bad.count() == 100 and bad.filter("reason = 'low'").count() == 10


def test_quartile_with_ties_and_few_rows(spark):
    for values in ([5], [1, 2], [1, 1, 1, 9], list(range(101)), [3] * 50 + [7] * 50):
        d = spark.createDataFrame([(float(v),) for v in values], "v double")
        assert R.nearest_rank_quartile(d, "v").first().threshold == sorted(values)[int((len(values) - 1) * 0.75)]


def test_knn_across_latitude_zones(spark):
    import random

    rng = random.Random(3)
    pts = [(k, 39.8 + rng.random() * 0.4, -74 + rng.random() * 0.4) for k in range(300)]
    d = spark.createDataFrame(pts, "id long, lat double, lon double")
    got = rows(knn_within(d, d.withColumnRenamed("id", "other"), "id", "other", "lat", "lon", 4, 3.0).select("id", "other"))
    from math import asin, cos, radians, sin, sqrt

    def miles(a, b):
        h = sin(radians(b[1] - a[1]) / 2) ** 2 + cos(radians(a[1])) * cos(radians(b[1])) * sin(radians(b[2] - a[2]) / 2) ** 2
        return 2 * 3958.7613 * asin(sqrt(h))

    expected = [(a[0], b[0]) for a in pts for b in sorted(pts, key=lambda b: (miles(a, b), b[0]))[:4] if miles(a, b) <= 3.0]
    assert got == sorted(expected, key=str)


def test_fuzzy_matches_brute_force(spark, sf_dir):
    p = read(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand"])
    a, b = p.filter("p_partkey % 5 = 0"), p.filter("p_partkey % 5 <> 0").withColumnRenamed("p_partkey", "candidate")
    key = address_key(F.col("p_name"))
    got = {(r.p_partkey, r.candidate): round(r.score, 9) for r in best_matches(a, b, "p_partkey", "candidate", (F.col("p_brand"), F.col("p_brand")), (key, key), top=3, least=0.4).collect()}
    left, right = (d.select("*", key.alias("key")).collect() for d in (a, b))
    expected = {}
    for x in left:
        scored = sorted(((-SequenceMatcher(None, x.key, y.key).ratio(), y.candidate) for y in right if y.p_brand == x.p_brand))
        expected |= {(x.p_partkey, c): round(-s, 9) for s, c in scored[:3] if -s >= 0.4}
    assert got == expected


def test_streams_can_run_again(spark, tmp_path, sf_dir):
    events = read(spark, sf_dir, "events")
    source, out, done = (str(tmp_path / x) for x in ("in", "out", "done"))
    half = events.withColumn("k_", F.xxhash64("event_id") % 2)
    half.filter("k_ = 0").drop("k_").repartition(3).write.parquet(source)
    stream = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    run = lambda: incremental.append_available(incremental.first_contents(stream(), ["user_id"], ["event_type", "value"]), out, done)
    run()
    run()
    distinct = lambda d: d.select("user_id", "event_type", "value").distinct().count()
    assert spark.read.parquet(out).count() == distinct(half.filter("k_ = 0"))
    half.filter("k_ <> 0").drop("k_").repartition(2).write.mode("append").parquet(source)
    run()
    assert spark.read.parquet(out).count() == distinct(events)


def test_stream_changes_and_windows(spark, tmp_path, sf_dir):
    from auctionlake.operators.windows import changes

    events = read(spark, sf_dir, "events", ["event_id", "user_id", "ts", "event_type"]).withColumn("event_type", F.when(F.col("event_id") % 9 != 0, F.col("event_type")))
    source, out, done = (str(tmp_path / x) for x in ("in", "out", "done"))
    cuts = events.approxQuantile("event_id", [0.4, 0.7], 0.0)
    ordered = spark.createDataFrame(events.orderBy("ts", "event_id").toPandas().assign(n=range(events.count())), T.StructType([*events.schema, T.StructField("n", T.LongType())]))
    for low, high in ((-1, cuts[0]), (cuts[0], cuts[1]), (cuts[1], 1e18)):  # what comes later in time comes in a later batch
        ordered.filter((F.col("n") > low) & (F.col("n") <= high)).drop("n").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        incremental.append_available(incremental.changed_rows(stream, ["user_id"], ["ts", "event_id"], ["event_type"]), out, done)
    assert rows(spark.read.parquet(out)) == rows(changes(events, ["user_id"], ["ts", "event_id"], ["event_type"]))
    assert incremental.windowed_counts(events, "ts", ["event_type"]).agg(F.sum("n")).first()[0] == events.count()


def test_knn_without_itself_at_crowded_places(spark):
    """Sixty rows at each of two places: a row's nearest are the lowest ids of its place but for its own, and tiles without targets are no error."""
    pts = [(k, 40.0 if k % 2 else 40.05, -74.0) for k in range(120)] + [(k, 40.2 + k / 1e5, -74.2) for k in range(120, 140)]
    d = spark.createDataFrame(pts, "id long, lat double, lon double")
    got = rows(knn_within(d.filter("id < 60"), d.withColumnRenamed("id", "other"), "id", "other", "lat", "lon", 3, 3.0, itself=False).select("id", "rank", "other"))
    want = sorted(((k, i + 1, o) for k in range(60) for i, o in enumerate([o for o in range(k % 2, 120, 2) if o != k][:3])), key=str)
    assert got == want


def test_later_partners_of_repeated_texts(spark):
    """Rows repeat few texts; each row's best partners are those with higher ids, as all pairs say."""
    import random

    rng = random.Random(4)
    texts = ["".join(rng.choice("ABC") for _ in range(rng.randint(3, 7))) for _ in range(14)]
    data = [(k, "x" if rng.random() < 0.7 else "y", rng.choice(texts)) for k in range(150)]
    d = spark.createDataFrame(data, "id long, block string, name string")
    got = rows(best_matches(d, d.withColumnRenamed("id", "other"), "id", "other", (F.col("block"),) * 2, (F.col("name"),) * 2, least=0.5, later=True))
    want = []
    for i, b, n in data:
        near = sorted((-r, j) for j, c, m in data if c == b and j > i and (r := SequenceMatcher(None, n, m).ratio()) >= 0.5)
        want += [(i, j, -r, k + 1) for k, (r, j) in enumerate(near[:5])]
    assert got == sorted(want, key=str)


def test_ratios_of_many_pairs_at_once():
    import random

    from auctionlake.operators.fuzzy import ratios

    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("ABé1 ") for _ in range(n))
    pairs = [(text(rng.randrange(16)), text(rng.randrange(16))) for _ in range(3000)] + [("", ""), (text(230), text(260))]
    assert ratios(pairs) == [SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_candidates_that_share_no_character(spark):
    from auctionlake.operators.fuzzy import any_alike

    a = spark.createDataFrame([(1, "x", "ABC"), (2, "x", "DEF"), (3, "y", "ABC"), (4, None, "A"), (5, "x", "")], "id long, block string, name string")
    b = spark.createDataFrame([("x", "CXX"), ("y", "QQ")], "block string, name string")
    assert rows(any_alike(a, b, "id", (F.col("block"),) * 2, (F.col("name"),) * 2)) == [(1,)]


def test_resolver_counts_parcels_that_share_key_and_address(spark):
    """Two thousand parcels of one lot and address are one comparison for all sales, and still two thousand candidates."""
    from auctionlake.domain import identity
    from auctionlake.functions.text import address_parts, address_supports, parts_support

    sales = spark.range(2000).select(F.col("id").alias("sale_id"), F.lit("C").alias("county"), F.lit("T").alias("city"), F.lit("1 Elm St").alias("street_address"), F.lit("1 Elm St").alias("normalized_address"))
    ids = spark.range(1000).select(F.col("id").alias("sale_id"), F.lit(0).alias("position"), F.when(F.col("id") % 2 == 0, "5").otherwise("6").alias("block"), F.lit("1").alias("lot"), F.lit(None).cast("string").alias("qualifier"))
    crowd = spark.range(2000).select(F.col("id").alias("parcel_id"), *[F.lit(v).alias(c) for c, v in {"county": "C", "municipality_code": "M", "block": "5", "lot": "1", "qualifier": "", "normalized_address": "1ELMST", "current_address": "1 Elm St"}.items()])
    one = crowd.limit(1).withColumn("block", F.lit("6")).withColumn("parcel_id", F.lit(9000).cast("long")).withColumn("normalized_address", F.lit("Q"))
    aliases = spark.createDataFrame([("C", "T", "M")], "county string, alias string, municipality_code string")
    got = identity.resolve(sales, ids, crowd.unionByName(one), aliases).groupBy("match_kind", "parcel_id").count()
    assert rows(got) == sorted([("REVIEW_LEGAL", None, 500), ("LEGAL_SINGLE", 9000, 500), ("REVIEW_ADDRESS", None, 1000)], key=str)
    pair = spark.createDataFrame([("12 Main St and 14 Oak Rd", "14 Oak Road"), (None, "1 A"), ("12 A", "2 A"), ("12 A", "13 A")], "s string, c string")
    for r in pair.select(address_supports(F.col("s"), F.col("c")).alias("x"), parts_support(address_parts(F.col("s")), address_parts(F.col("c"))).alias("y")).collect():
        assert r.x == r.y


def test_latest_flag_of_lines_that_share_their_key(spark, tmp_path):
    """Equal order and line numbers: ship date and then flag decide, in the query and in its SQL, whatever the order of the rows."""
    import duckdb

    from auctionlake.plans import catalog

    catalog.load()
    lines = [(1, 7, 1, "2020-01-01", "R"), (1, 7, 1, "2020-01-02", "A"), (2, 3, 10, "2020-01-01", "A"), (2, 4, 1, "2020-01-01", "N"), (2, 4, 1, "2020-01-01", "R"), (3, 1, 1, "2020-01-01", None), (3, 1, 1, "2020-01-01", "A")]
    want = [(1, "A"), (2, "R"), (3, "A")]
    for k, data in enumerate((lines, lines[::-1])):
        d = spark.createDataFrame(data, "l_suppkey long, l_orderkey long, l_linenumber int, l_shipdate string, l_returnflag string").withColumn("l_shipdate", F.to_timestamp("l_shipdate"))
        d.coalesce(1).write.parquet(f"{tmp_path}/{k}/lineitem.parquet")
        got = catalog.QUERIES["first_last_seen"](spark, f"{tmp_path}/{k}").select("l_suppkey", "latest_flag")
        assert rows(got) == want
        con = duckdb.connect()
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/{k}/lineitem.parquet/*.parquet')")
        assert sorted((r[0], r[3]) for r in con.execute(catalog.ORACLES["first_last_seen"]).fetchall()) == want


def test_fixed_width_lines_take_little_disk(spark, tmp_path):
    from auctionlake.sources import fixed_width

    d = spark.range(3000).select(F.concat(F.rpad(F.col("id").cast("string"), 662, " "), F.lit("é")).alias("value"))
    fixed_width.write_lines(d.coalesce(1), str(tmp_path / "lines"))
    again = fixed_width.read_lines(spark, str(tmp_path / "lines")).select("value")
    assert rows(again) == rows(d)
    assert sum(p.stat().st_size for p in (tmp_path / "lines").rglob("part-*")) < 663 * 3000 / 10


def test_sides_prepared_before_their_join_score_the_same(spark):
    from auctionlake.domain import identity

    columns = ("municipality_code", "block", "lot", "qualifier", "address", "zip_code")
    data = [("1308", "12.01", "7", None, "12 Main St", "07712"), ("1309", "012", "", "Q1", "12B Oak Avenue", None), (None, None, None, None, None, "07712-1111")]
    s, c = (spark.createDataFrame(data, ", ".join(f"{x}_{k} string" for k in columns)) for x in "sc")
    kept = [*s.columns, *c.columns, "components", "total", "conflicts", "decision"]
    apart = identity.score_prepared(identity.scored_parts(s, "s").crossJoin(identity.scored_parts(c, "c"))).select(*kept)
    assert rows(apart) == rows(identity.score_pairs(s.crossJoin(c)).select(*kept))


def test_first_partners_of_repeated_texts(spark):
    """All rows of a text have the same partners; only distinct texts of a block go to the ratio."""
    from auctionlake.operators.fuzzy import _alike

    texts = ["ABCA", "ABCB", "AABC", "CCCC"]
    data = [(k, "x" if k % 3 else "y", texts[k % 4]) for k in range(60)]
    d = spark.createDataFrame(data, "id long, block string, name string")
    got = rows(best_matches(d.filter("id % 10 = 0"), d.filter("id % 10 <> 0").withColumnRenamed("id", "other"), "id", "other", (F.col("block"),) * 2, (F.col("name"),) * 2, top=3, least=0.3))
    want = []
    for i, b, n in data[::10]:
        near = sorted((-r, j) for j, c, m in data if c == b and j % 10 and (r := SequenceMatcher(None, n, m).ratio()) >= 0.3)
        want += [(i, j, -r, k + 1) for k, (r, j) in enumerate(near[:3])]
    assert got == sorted(want, key=str)
    distinct = d.select(F.col("block").alias("b_"), F.col("name").alias("ln_")).distinct()
    assert _alike(distinct, distinct.withColumnRenamed("ln_", "rn_"), 0.0).count() <= 2 * 16
