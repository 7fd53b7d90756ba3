"""Roads against brute force, layers that are reused, lookups that open one file, profiles, numbers."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mobilis.functions import arrays
from mobilis.operators import graph, numbering, profiles, roads
from mobilis.plans import graph_queries, place_queries
from mobilis.sources import canonical, feeds, layers
from mobilis.sources.folders import new_folder, stored, versions
from mobilis.sources.store import Store


def plain_chains(members):
    """{(relation, member): (chain, place, reversed, closed)} by walking."""
    out = {}
    for relation in {m[0] for m in members}:
        ways = {m[1]: m[2:] for m in members if m[0] == relation}
        at = {}
        for m, (a, b) in ways.items():
            for end, back in ((a, False), (b, True)):
                if end is not None:
                    at.setdefault(end, []).append((m, back))

        def onward(m, back):
            head = ways[m][0] if back else ways[m][1]
            there = at.get(head, [])
            if len(there) != 2:
                return None
            mirror = (m, not back)
            return there[1] if there[0] == mirror else there[0]

        left = set(ways)
        while left:
            m = min(left)
            line, seen = [(m, False)], {(m, False)}
            while (n := onward(*line[-1])) and n not in seen:
                line.append(n)
                seen.add(n)
            ring = n is not None
            if not ring:
                start = [(m, True)]
                while n := onward(*start[-1]):
                    start.append(n)
                line = [(x, not back) for x, back in reversed(start)][:-1] + line
                if line[0][0] > line[-1][0]:
                    line = [(x, not back) for x, back in reversed(line)]
            for k, (x, back) in enumerate(line):
                out[relation, x] = (m, k, back, ring or ways[x][0] == ways[x][1] is not None)
                left.discard(x)
    return out


def test_chains(spark):
    rng = random.Random(5)
    members = [(0, 3, "a", "b"), (0, 1, "c", "b"), (0, 2, "c", "d"), (0, 9, "x", "y")]  # reversed members, and a gap
    members += [(1, k, f"p{k}", f"p{(k + 1) % 7}") for k in range(7)] + [(2, k, *((f"q{k}", f"q{(k + 1) % 5}") if k % 2 else (f"q{(k + 1) % 5}", f"q{k}"))) for k in range(5)]  # rings
    members += [(3, 0, "a", "a"), (3, 1, "b", "c"), (3, 2, "c", "c"), (4, 0, None, None), (4, 1, None, "z"), (4, 2, "z", "y"), (5, 0, "a", "b"), (5, 1, "a", "b")]
    order = list(range(300))
    rng.shuffle(order)
    members += [(6, m, *((f"l{k}", f"l{k + 1}") if rng.random() < 0.5 else (f"l{k + 1}", f"l{k}"))) for k, m in enumerate(order)]  # a long line
    for relation in range(10, 40):
        members += [(relation, m, f"v{rng.randrange(9)}", f"v{rng.randrange(9)}") for m in range(rng.randrange(1, 10))]
    rows = spark.createDataFrame(members, "relation long, member long, a string, b string").repartition(4)
    got = {(r.relation, r.member): (r.chain, r.place, r.reversed, r.closed) for r in roads.chained(rows).collect()}
    assert got == plain_chains(members)
    assert roads.chained(rows.limit(0)).count() == 0


def moved(spark, job):
    """Bytes that the stages of a job shuffle, spill and write."""
    context = spark.sparkContext._jsc.sc()

    def stages():
        context.listenerBus().waitUntilEmpty()
        gateway = spark.sparkContext._gateway
        listed = context.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() + s.diskBytesSpilled() + s.outputBytes() for s in (listed.apply(i) for i in range(listed.size()))}

    before = stages()
    job()
    return sum(n for stage, n in stages().items() if stage not in before)


def test_chains_of_small_relations_move_their_members_once(spark):
    job = lambda: place_queries.road_chains(spark, "/root/testdata/sf0.01").write.format("noop").mode("overwrite").save()
    members = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").count()
    assert 0 < moved(spark, job) < 100 * members


def test_chains_together_by_pointers_and_both(spark):
    rng = random.Random(6)
    members = [(None, 0, "a", "b"), ("all null", 0, None, None), ("all null", 1, None, None)]
    for relation in range(60):  # few places make joints of three and more, many make gaps, and shuffled members run either way
        places = rng.choice([3, 9, 40])
        members += [(f"r{relation}", 3 * m, *(rng.choice([None, *"abcdefgh", *map(str, range(places))]) for _ in "ab")) for m in rng.sample(range(50), rng.randrange(1, 30))]
    for name, n, turns in (("line", 200, 0), ("ring", 150, 1)):
        order = rng.sample(range(n), n)
        members += [(name, m, *((f"{k}", f"{(k + 1) % n if turns else k + 1}")[:: rng.choice([1, -1])])) for k, m in enumerate(order)]
    rng.shuffle(members)
    rows = spark.createDataFrame(members, "relation string, member long, a string, b string").repartition(5)
    want = plain_chains([m for m in members if m[0] is not None])
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for together, batch in ((4_096, size), (4_096, "7"), (12, size), (0, size)):  # batches end inside relations
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            found = roads.chained(rows, together).collect()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = {(r.relation, r.member): (r.chain, r.place, r.reversed, r.closed) for r in found}
        assert len(found) == len(want) and got == want


def test_relation_members_are_read_from_elements(spark):
    lines = [
        '{"type":"relation","id":7,"members":[{"type":"way","ref":1,"geometry":[{"lat":1.5,"lon":2},{"lat":1,"lon":3}]},{"type":"node","ref":2},{"type":"way","ref":3,"geometry":[{"lat":1,"lon":3}]}]}',
        '{"type":"way","id":8,"geometry":[]}', '{"type":"relation","id":9}',
    ]
    records = canonical.parsed(spark.createDataFrame([(x,) for x in lines], "payload string"))[0]
    assert [tuple(r) for r in feeds.relation_members(records).collect()] == [("7", 0, 1, "1.5,2.0", "1.0,3.0")]


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "5000")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        df.sparkSession.conf.unset("spark.sql.maxMetadataStringLength")


def test_a_layer_is_fetched_once_in_twelve_hours_and_asked_at_the_scan(spark):
    folder, fetched = new_folder(spark, "layers"), []
    landing = new_folder(spark, "landed")
    spark.range(500).selectExpr("concat('{\"geometry\":{\"coordinates\":[', id / 100, ',', id % 50, ']},\"properties\":{\"A\":', id, ',\"B\":null}}') AS value").write.text(landing)

    def fetch():
        fetched.append(1)
        return layers.typed_features(canonical.parsed(canonical.raw(spark, landing))[0], ["A", "B"])

    t0 = datetime(2024, 1, 1)
    read = lambda hours: layers.reused(spark, folder, "signals", t0 + timedelta(hours=hours), fetch, ["lat", "lon"])
    first = read(0)
    again = read(11.99)
    assert len(fetched) == 1 and set(again.inputFiles()) == set(first.inputFiles())
    assert all(folder.split("/")[-1] in f and landing.split("/")[-1] not in f for f in again.inputFiles())  # nothing landed is opened
    assert first.count() == 500
    later = read(12)
    assert len(fetched) == 2 and set(later.inputFiles()) != set(first.inputFiles()) and later.count() == 500
    read(30)
    assert len(versions(spark, f"{folder}/signals")) == 2
    box = layers.within(later, (3, 1, 7, 2), ["A"])
    text = plan(box)
    assert "GreaterThanOrEqual(lat,3.0)" in text and "LessThanOrEqual(lon,2.0)" in text and "ReadSchema: struct<lon:double,lat:double,A:string>" in text
    assert box.count() == sum(1 for k in range(500) if 3 <= k % 50 <= 7 and 1 <= k / 100 <= 2)
    stations = spark.createDataFrame([("s", None, None, None, "in Auburn", "1"), ("t", None, None, None, "Auburn", "0")], "Station string, RouteID string, YearAADT string, AADT string, Location string, IsActive string")
    near = layers.active_near(stored(stations), "Auburn")
    assert near.count() == 1 and "StringContains(Location,Auburn)" in plan(near)


def test_a_lookup_opens_one_file_and_few_row_groups(spark):
    s = Store(spark, new_folder(spark, "stores"), {"evidence": ("id string, what string", ["id"])}, 8, bloom={"evidence": "id"}, row_group=1 << 14)
    rows = spark.range(60_000).selectExpr("sha2(cast(id as string), 256) AS id", "repeat('x', 40) AS what")
    s.commit(s.state(), {"evidence": (rows, list(range(8)))})
    wanted = rows.where("id LIKE 'ab%'").limit(3).collect()
    state = s.state()
    for r in wanted:
        found = s.find("evidence", [(r.id,)])
        assert len(found.inputFiles()) == 1 and f"EqualTo(id,{r.id})" in plan(found)
        assert [x.id for x in found.collect()] == [r.id]
    from pyarrow import parquet

    (path,) = s.find("evidence", [(wanted[0].id,)]).inputFiles()
    meta = parquet.ParquetFile(path.replace("file://", "").replace("file:", "")).metadata
    assert meta.num_row_groups > 3
    # what is read of the file: the filters of the other row groups say that the id is not there
    found = s.find("evidence", [(wanted[0].id,)])
    found.collect()
    scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    read = scan.metrics().apply("numOutputRows").value()
    assert 0 < read <= 2 * meta.num_rows / meta.num_row_groups < meta.num_rows
    assert s.find("evidence", [("none",)]).count() == 0 and s.lookup("evidence", rows.limit(5).select("id"), state).count() == 5


def test_numbers_within_keys_of_any_size(spark):
    rows = spark.range(20_000).selectExpr("if(id % 3 = 0, null, if(id % 2 = 0, 'hot', concat('k', id % 50))) AS key", "hash(id) AS h", "id")
    wide = rows.repartition(16)
    got = numbering.numbered(wide, ["key"], ["h", "id"])
    want = {}
    for key, h, k in sorted((tuple(r) for r in rows.collect()), key=lambda r: (str(r[0]), r[1], r[2])):
        want.setdefault(key, []).append(k)
    assert {(r.key, r.id): r.number for r in got.collect()} == {(key, k): n for key, ids in want.items() for n, k in enumerate(ids)}
    assert numbering.numbered(wide.limit(0), ["key"], ["id"]).count() == 0


def test_findings_and_decisions_alike_in_their_order(spark):
    when = datetime(2024, 1, 1)
    incidents = spark.createDataFrame([("i", "t")], "incident_id string, title string")
    recommendations = spark.createDataFrame([("r1", "i", 1, "a", "approved"), ("r2", "i", 2, "a", "approved")], "recommendation_id string, incident_id string, rank long, action string, state string")
    evidence = spark.createDataFrame([], "recommendation_id string, evidence_id string, summary string")
    commitments = spark.createDataFrame([], "commitment_id string, decision_id string, recommendation_id string, outcome string, state string, rule string")
    findings = [("r2", "d", "abstained", when, [], 0), ("r1", "d", "contributed", when, [], 5), ("r1", "d", "pending", when, [], 9)]
    decisions = [("d1", "r1", "approve", "first", when, 3), ("d1", "r1", "approve", "second", when, 4)]
    for turn in (1, -1):
        said = spark.createDataFrame(findings[::turn], "recommendation_id string, desk_code string, status string, created_at timestamp_ntz, cited array<string>, place long").coalesce(1)
        decided = spark.createDataFrame(decisions[::turn], "decision_id string, recommendation_id string, action string, actor string, decided_at timestamp_ntz, place long").coalesce(1)
        nodes, _ = graph.lineage(incidents, recommendations, evidence, said, decided, commitments)
        got = [(r.node_type, r.label, r.flag) for r in nodes.collect()]
        assert [g for g in got if g[0] == "finding"] == [("finding", "d · contributed", "contributed")]
        assert sorted(g for g in got if g[0] == "decision") == [("decision", "approve · first", "current"), ("decision", "approve · second", "historical")]


def test_a_lineage_in_columns(spark):
    edges = [("e1", "f1", 1), ("e2", "f1", 2), ("e2", "f1", 1), ("e1", "f2", 1), ("f1", "i", 1), ("f2", "i", 1), ("e9", "i", 4), ("i", "r", 3)]
    rows = spark.createDataFrame(edges, "src string, dst string, weight long")
    nodes, merged = graph.layered(rows)
    assert {r.node_id: (r.column, r.position, r.n_in, r.n_out) for r in nodes.collect()} == {"e1": (0, 0, 0, 2), "e2": (0, 1, 0, 3), "e9": (0, 2, 0, 4), "f2": (1, 0, 1, 1), "f1": (1, 1, 4, 1), "i": (2, 0, 6, 3), "r": (3, 0, 3, 0)}
    assert merged.count() == 7
    with pytest.raises(ValueError):
        graph.columns_of(spark.createDataFrame([("s", "a"), ("a", "b"), ("b", "a")], "src string, dst string"), most=10)


def test_a_document_moves_each_table_once(spark, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = {t: stored(spark.range(40).selectExpr("id % 10 AS recommendation_id", "id AS at", "if(id % 2 = 0, id, null) AS what")) for t in ("evidence", "decisions", "commitments", "verifications")}
        recommendations = stored(spark.range(12).selectExpr("id AS recommendation_id", "id % 3 AS incident_id", "cast(null AS string) AS by"))
        incidents = stored(spark.range(2).selectExpr("id AS incident_id", "'t' AS title"))
        out = graph.decision_documents(recommendations, incidents, {t: (df, ["at"]) for t, df in made.items()})
        rows = {r.recommendation_id: r.lineage for r in out.collect()}
        exchanges = sum("Exchange hashpartitioning" in line for line in plan(out).split("== Initial Plan ==")[0].splitlines())
        assert exchanges == 2 + 1 + 4  # recommendations move to their incidents and from there; all others once
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert set(rows) == {k for k in range(12) if k % 3 < 2}
    assert rows[10].startswith('{"recommendation":{"recommendation_id":10,"incident_id":1,"by":null},"incident":{"incident_id":1,"title":"t"},"evidence":[],')
    assert '"evidence":[{"at":1,"what":null},{"at":11,"what":null},{"at":21,"what":null},{"at":31,"what":null}]' in rows[1]


def test_profiles_and_ordered_arrays(spark):
    items = [(1, "a"), (2, "b"), (1, "c"), (None, "d"), (2, "e"), (None, "f")]
    df = spark.createDataFrame([(items,), ([],), (None,)], "x array<struct<id:int,v:string>>")
    got = df.select(arrays.first_of_each(F.col("x")).alias("f"), arrays.last_of_each(F.col("x")).alias("l")).collect()
    assert [[tuple(i) for i in r.f] if r.f is not None else None for r in got] == [[(1, "a"), (2, "b"), (None, "d")], [], None]
    assert [[tuple(i) for i in r.l] if r.l is not None else None for r in got] == [[(1, "c"), (2, "e"), (None, "f")], [], None]
    schema = "desk_code string, role string, backstory string, instructions string, model string, temperature double, enabled_tools array<string>, policies array<struct<id:string,title:string,jurisdiction:string,source:string,body:string>>, submitted_at timestamp_ntz"
    t0, t1 = datetime(2024, 1, 1), datetime(2024, 1, 2)
    policy = ("p", "  T ", "state", "s", " b\n")
    draft = ("atlas", " r\n", "", None, "m", 0.125, ["unknown", "b"], [policy, ("p", "other", "", "", "")], t0)
    make = lambda *rows: spark.createDataFrame(rows, schema)
    none = make().withColumn("updated_at", F.col("submitted_at")).drop("submitted_at")
    first = profiles.normalized(make(draft, ("echo", None, None, None, None, None, None, None, t0)), none, ["a", "b", "c"], ["c"])
    rows = {r.desk_code: r for r in first.collect()}
    assert (rows["atlas"].role, rows["atlas"].temperature, rows["atlas"].enabled_tools, [tuple(p) for p in rows["atlas"].policies]) == ("r", 0.13, ["b", "c"], [("p", "T", "state", "s", "b")])
    assert (rows["echo"].enabled_tools, rows["echo"].policies, rows["echo"].changed) == (["c"], [], True)
    same, other = (*draft[:-1], t1), ("echo", "x", None, None, None, None, None, None, t1)
    again = {r.desk_code: (r.updated_at, r.changed) for r in profiles.normalized(make(same, other), first.drop("changed"), ["a", "b", "c"], ["c"]).collect()}
    assert again == {"atlas": (t0, False), "echo": (t1, True)}


def test_weights_of_a_lineage_need_no_columns(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("columns are not asked for")

    monkeypatch.setattr(graph, "columns_of", refused)
    found = graph_queries.lineage_weights(spark, "/root/testdata/sf0.001")
    assert found.where("weight < 1 OR weight IS NULL").count() == 0 and found.count() == found.select("src", "dst").distinct().count()


def moved_bytes(spark, run):
    """Bytes that the stages of ``run`` shuffle, spill and write."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def so_far():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() + s.diskBytesSpilled() + s.outputBytes() for s in (stages.apply(k) for k in range(stages.size()))}

    before = so_far()
    run()
    return sum(n for k, n in so_far().items() if k not in before)


@pytest.mark.parametrize("name, most", [("lineage_weights", 100), ("lineage_columns", 300)])
def test_a_weighed_lineage_moves_keys_and_each_line_once(spark, name, most):
    folder = "/root/testdata/sf0.01"
    n_lines = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    spent = moved_bytes(spark, lambda: graph_queries.Q[name](spark, folder).write.format("noop").mode("overwrite").save())
    assert 0 < spent / n_lines < most


def test_a_weighed_lineage_of_odd_tables(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SELECT setseed(0.5)")
    # orders and customers repeat or are missing, orders have several customers or no lines, evidence is first known late
    con.execute("CREATE TABLE orders AS SELECT CAST(k % 67 + 5 AS BIGINT) AS o_orderkey, CAST((k * 7) % (CASE WHEN k < 67 THEN 19 ELSE 4 END) AS BIGINT) AS o_custkey, 'F' AS o_orderstatus, '1' AS o_orderpriority FROM range(80) t(k)")
    con.execute("CREATE TABLE customer AS SELECT CAST(k % 14 AS BIGINT) AS c_custkey, 'n' || k AS c_name, CASE WHEN k % 5 = 2 THEN -1.0 ELSE 1.0 END AS c_acctbal FROM range(17) t(k)")
    con.execute(
        """CREATE TABLE lineitem AS SELECT CAST(CASE WHEN k % 11 = 0 THEN 20 ELSE floor(random() * 66) END AS BIGINT) AS l_orderkey, CAST(floor(random() * 30) AS BIGINT) AS l_partkey, CAST(floor(random() * 40) AS BIGINT) AS l_suppkey, CAST(1 + floor(random() * 7) AS INTEGER) AS l_linenumber,
        10.0 AS l_quantity, random() * 0.08 AS l_tax, CASE WHEN random() < 0.8 THEN 'N' WHEN random() < 0.5 THEN 'A' ELSE 'R' END AS l_returnflag, 'O' AS l_linestatus, TIMESTAMP '2024-01-01' + to_days(CAST(floor(random() * 2) AS INTEGER)) AS l_shipdate FROM range(330) t(k)"""
    )
    for name in ("orders", "customer", "lineitem"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    for name in ("lineage_weights", "lineage_columns"):
        want = con.execute(graph_queries.SQL[name])
        names = [c[0] for c in want.description]
        got = sorted(tuple(r) for r in graph_queries.Q[name](spark, str(tmp_path)).select(*names).collect())
        assert got == sorted(want.fetchall()) and len(got) > 100


def test_numbered_rows_of_few_keys_stay_where_they_are(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "50000")
    try:
        rows = spark.range(60_000).selectExpr("id % 2 AS key", "hash(id) AS h", "id")
        spent = moved_bytes(spark, lambda: numbering.numbered(stored(rows), ["key"], ["h", "id"]).write.format("noop").mode("overwrite").save())
        once = moved_bytes(spark, lambda: stored(stored(rows).repartitionByRange("key", "h", "id")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert spent < 1.6 * once
