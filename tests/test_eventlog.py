import random

from pyspark.sql import functions as F

from playlake.operators import eventlog


def events(spark, rows, extra=""):
    return spark.createDataFrame(rows, "id string, seq long, at long, event string" + extra)


def test_edit_log(spark):
    rows = [("e1", 0, 10, "queued", None), ("e1", 1, 11, "failed", "a"), ("e2", 2, 12, "queued", None), ("e1", 3, 13, "applied", None), ("e1", 4, 14, "failed", "late"), ("x", 5, 15, "failed", "orphan"), ("e2", 6, 16, "failed", "a"), ("e2", 7, 17, "failed", "b"), ("e2", 8, 18, "queued", None)]
    got = [(r.id, r.state, r.attempts, r.last_error, r.created_at, r.updated_at) for r in eventlog.fold_edit_log(events(spark, rows, ", error string")).orderBy("place").collect()]
    assert got == [("e1", "applied", 1, "a", 10, 14), ("e2", "pending", 2, "b", 12, 17)]


def fold(rows):
    """The state machine in plain Python."""
    out = {}
    for id_, _seq, at, event, approval, dismiss in rows:
        if event == "created":
            if id_ not in out:
                out[id_] = {"state": "awaiting_approval" if approval else "ready", "approval": approval, "dismissed": False, "created": at, "updated": at}
            continue
        if id_ not in out:
            continue
        s = out[id_]
        s["updated"] = at
        if event == "approved" and s["state"] == "awaiting_approval":
            s["state"] = "ready"
        elif event == "rejected":
            s["state"], s["dismissed"] = "rejected", dismiss
        elif event == "reinstated" and s["state"] == "rejected":
            s["state"], s["dismissed"] = ("awaiting_approval" if s["approval"] else "ready"), False
        elif event == "expanded" and s["state"] in ("ready", "in_progress"):
            s["state"] = "in_progress"
        elif event == "completed":
            s["state"] = "applied"
        elif event == "abandoned":
            s["state"] = "abandoned"
    return out


def test_queue_against_state_machine(spark):
    rng, rows = random.Random(3), []
    kinds = ["created", "approved", "rejected", "reinstated", "expanded", "completed", "abandoned", "applied", "failed"]
    weights = [2, 3, 2, 4, 4, 1, 1, 1, 1]
    for seq in range(6000):
        rows.append((f"i{rng.randint(0, 700)}", seq, seq * 2, rng.choices(kinds, weights)[0], rng.random() < 0.5, rng.random() < 0.5))
    got = {r.id: (r.state, r.requires_approval, r.dismissed, r.created_at, r.updated_at) for r in eventlog.fold_queue(events(spark, rows, ", requires_approval boolean, dismiss boolean")).collect()}
    want = {k: (s["state"], s["approval"], s["state"] == "rejected" and s["dismissed"], s["created"], s["updated"]) for k, s in fold(rows).items()}
    assert got == want


def test_instances(spark):
    rows = [("i", 0, 0, "expanded", "10", None), ("i", 1, 0, "expanded", "20", None), ("i", 2, 0, "applied", "10", None), ("i", 3, 0, "failed", "20", "x"), ("i", 4, 0, "failed", "20", "y"), ("i", 5, 0, "expanded", "10", None), ("i", 6, 0, "expanded", "30", None)]
    ins = eventlog.fold_instances(events(spark, rows, ", instance string, error string"))
    assert {r.instance: (r.status, r.attempts, r.last_error) for r in ins.collect()} == {"10": ("applied", 0, None), "20": ("failed", 2, "y"), "30": ("pending", 0, None)}
    live = spark.createDataFrame([("10",), ("20",)], "id string")
    assert eventlog.completion(ins, live, 2).first().outcome == "abandoned"
    assert eventlog.completion(ins, live, 3).first().outcome == "open"
    assert eventlog.completion(ins, live.filter("id = '10'"), 3).first().outcome == "completed"


def test_dismissed(spark):
    rows = spark.createDataFrame([("a", None, 1, 0, True), ("a", None, 1, 1, False), ("b", None, 1, 2, None)], "artist string, album string, at long, seq long, active boolean")
    assert [r.artist for r in eventlog.fold_dismissed(rows, ["artist", "album"]).collect()] == ["b"]


def test_backoff(spark):
    df = spark.range(6).select(eventlog.backoff(F.col("id").cast("int"), F.lit(None).cast("long")).alias("p"))
    assert [r.p for r in df.collect()] == [60, 120, 240, 480, 600, 600]
    assert spark.range(1).select(eventlog.backoff(F.lit(0), F.lit(200))).first()[0] == 200
    assert spark.range(1).select(eventlog.backoff(F.lit(0), F.lit(1000))).first()[0] == 600


def test_rate_limits(spark):
    rows = [(1, 0, 100, "rate_limited", None, 10), (1, 1, 105, "rate_limited", None, 60), (1, 2, 110, "response", 500, None), (1, 3, 111, "response", 200, None), (1, 4, 120, "rate_limited", None, None)]
    df = spark.createDataFrame(rows, "k long, seq long, at long, event string, status int, delay long")
    assert sorted((r.since, r.until, r.n) for r in eventlog.rate_limit_episodes(df, ["k"]).collect()) == [(100, 165, 2), (120, 180, 1)]
