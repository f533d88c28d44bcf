"""The stream replays to the same state as the batch, whatever the order and the number of deliveries."""

import datetime as dt

from rulegrid.operators.changes import in_force
from rulegrid.sources import uploads
from rulegrid.streaming import assertions

SCHEMA = "seq long, identity_hash string, full_hash string, verdict string, effective_from date, corrects_seq long"


def test_stream_equals_batch(spark, tmp_path):
    d = dt.date
    batches = [
        [(1, "a", "h1", "new", d(2024, 1, 1), None), (2, "b", "h2", "new", d(2024, 1, 1), None)],
        [(3, "A", "h3", "amendment", d(2025, 1, 1), None), (1, "a", "h1", "new", d(2024, 1, 1), None)],
        [(4, "b", "h4", "repeal", d(2023, 1, 1), None), (5, None, "h5", "new", d(2024, 1, 1), 3)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    state = {}

    def write(df, number):
        state.update({r.identity_hash: r.full_hash for r in df.collect()})

    query = assertions.keep_current(assertions.log_stream(spark, str(tmp_path / "in")), str(tmp_path / "log"), write, str(tmp_path / "cp"))
    query.awaitTermination()
    want = {r.identity_hash: r.full_hash for r in in_force(spark.read.parquet(str(tmp_path / "in"))).collect()}
    assert {k: v for k, v in state.items() if v} == want == {"a": "h1", "b": "h2"}


def test_windows_of_events(spark, tmp_path):
    spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 0, 5), "v", 2.0), (2, dt.datetime(2024, 1, 1, 0, 59), "v", 3.0)], "event_id long, ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "e")).schema).parquet(str(tmp_path / "e"))
    q = assertions.windowed_counts(stream).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.events, r.total) for r in spark.table("counted").collect()] == [(2, 5.0)]


def test_uploads(spark, tmp_path):
    (tmp_path / "My file (1).pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "other.txt").write_bytes(b"text")
    got = uploads.files(spark, str(tmp_path)).collect()
    assert [r.doc_id for r in got] == ["My-file-1-.pdf"] or [r.doc_id for r in got] == ["My-20file-20-1-.pdf"]
    docs = spark.createDataFrame([("d1", "t"), ("d2", "t"), ("d3", "u"), ("d4", None)], "doc_id string, text string")
    import hashlib

    done = spark.createDataFrame([("d1", hashlib.sha256(b"t").hexdigest())], "doc_id string, content_hash string")
    assert {r.doc_id: r.status for r in uploads.to_skip(docs, done).collect()} == {"d1": "done", "d2": "renamed", "d3": "new"}


def test_a_queue_is_retried_with_each_batch_of_clauses(spark, tmp_path):
    queue = [(1, None, None, "depends_on", "PENDING", 0, "D", None, "4", None), (2, None, None, "depends_on", "PENDING", 3, "D", None, "99", None), (3, None, None, "amends", "RESOLVED", 1, "D", None, "4", 7)]
    spark.createDataFrame(queue, "id int, from_clause_id int, from_obligation_id int, edge_type string, state string, attempts int, target_doc string, target_container string, target_clause_no string, resolved_clause_id int").write.parquet(str(tmp_path / "q/version=0"))
    schema = "id int, doc_id string, clause_no string, container string, citable boolean, created_at timestamp"
    for rows in ([(5, "D", "3", None, True, dt.datetime(2024, 1, 1))], [(6, "D", "4", None, True, dt.datetime(2024, 1, 2))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assertions.retry(stream, str(tmp_path / "q"), str(tmp_path / "cp")).awaitTermination()
    last = {r.id: (r.state, r.attempts, r.resolved_clause_id) for r in spark.read.parquet(str(tmp_path / "q/version=2")).collect()}
    assert last[2] == ("ABANDONED", 5, None) and last[3] == ("RESOLVED", 1, 7) and last[1][0] == "RESOLVED" and last[1][2] == 6


def test_functions_for_sql(spark):
    from rulegrid.functions import surface

    surface.register(spark)
    row = spark.sql("SELECT parse_rule('days_since([A.d]) <= 180 AND [A.x] == 5') AS p, parse_rule('a ~ b') AS q").first()
    assert row.p.valid and row.p.functions == ["days_since"] and row.p.identifiers == ["A.d", "A.x"] and row.p.literals == ["180", "5"] and not row.q.valid and row.q.error.startswith("bad character")
    nodes = spark.sql("SELECT n.* FROM (SELECT 'a < 1 AND b' AS t) CROSS JOIN LATERAL rule_nodes(t) AS n").collect()
    assert [(r.node, r.parent, r.kind, r.head) for r in nodes] == [(0, None, "and", None), (1, 0, "cmp", "<"), (2, 1, "ref", "a"), (3, 1, "num", "1"), (4, 0, "ref", "b")]
    assert [r.number for r in spark.sql("SELECT c.number FROM (SELECT 'clauses 4 and 5' AS t) CROSS JOIN LATERAL citations_in(t) AS c").collect()] == ["4", "5"]
    assert tuple(spark.sql("SELECT round(cosine_distance(array(1D, 0D), array(0.6D, 0.8D)), 6), jaccard(array('a', 'b'), array('b'))").first()) == (0.4, 0.5)
