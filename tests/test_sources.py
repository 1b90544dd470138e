import json

from pyspark.sql import functions as F

from mnemo.plans import spec
from mnemo.sources import normalize as N
from mnemo.sources import readers as R


def put(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return str(path)


def test_chat(spark, tmp_path):
    p = put(tmp_path / "c.json", [{"type": "message", "user": "U1", "text": "Hi <@U2> #Deploy https://x.io/a now testing", "ts": "1700000000.000100"}, {"user": "U2", "text": "re", "ts": "1700000010.5", "thread_ts": "1700000000.000100"}, {"bot_id": "B", "user": "U3", "text": "x", "ts": "1700000011"}, "{broken"])
    out = N.chat(R.chat(spark, p, "1600000000"), "C1", ["testing", "test"])
    assert spark.createDataFrame([], spec.CANONICAL).unionByName(out).count() == 2
    a, b = out.orderBy("activity.timestamp").collect()
    assert [t.name for t in a.topics] == ["deploy", "testing"] and a.mentions == ["U2"] and a.urls == ["https://x.io/a"]
    assert a.activity.parent_id is None and b.activity.parent_id == "C1:1700000000.000100"
    assert out.agg(F.min(F.unix_micros("activity.timestamp"))).first()[0] == 1700000000000100
    g = N.graph_tables(out.union(out))
    assert {k: v.count() for k, v in g.items()} == {"activities": 2, "persons": 2, "topics": 2, "containers": 1, "accounts": 2, "from_person": 2, "in_container": 2, "mentions": 2, "mentions_person": 1, "replies_to": 1, "owns": 2, "identifies": 2}


def test_pull_requests_comments_reviews(spark, tmp_path):
    u = {"login": "ann", "avatar_url": "a"}
    prs = put(tmp_path / "p.json", [{"number": 7, "title": "Add #perf", "body": "by @Bob", "user": u, "updated_at": "2024-01-02T00:00:00Z", "html_url": "https://g/o/r/pull/7", "labels": [{"name": "Bug"}, {"name": "perf"}]}, {"number": 8, "title": "old", "user": u, "updated_at": "2023-01-02T00:00:00Z"}])
    pulls = R.pulls(spark, prs, "2024-01-01")
    (r,) = N.pull_request(pulls, "o/r").collect()
    assert [(t.name, t.tier) for t in r.topics] == [("perf", "semantic"), ("bug", "ephemeral")] and r.mentions == ["bob"] and r.activity.source_id == "o/r#7"
    c = put(tmp_path / "c.json", [{"id": 1, "body": "ok", "user": u, "created_at": "2024-01-02T00:00:00Z", "html_url": "https://g/o/r/pull/7#c", "pull_request_url": "https://api/pulls/7"}, {"id": 2, "body": "no", "user": u, "html_url": "https://g/o/r/issues/3"}])
    assert [x.activity.parent_id for x in N.pull_comment(R.pull_comments(spark, c), "o/r").collect()] == ["o/r#7"]
    v = put(tmp_path / "v.json", [{"id": 1, "state": "APPROVED", "body": "fine", "user": u, "submitted_at": "2024-01-02T00:00:00Z", "html_url": "https://g/o/r/pull/7#r"}, {"id": 2, "state": "COMMENTED", "body": " ", "user": u, "submitted_at": "2024-01-02T00:00:00Z", "html_url": "https://g/o/r/pull/7"}, {"id": 3, "state": "APPROVED", "user": u, "html_url": "https://g/o/r/pull/9"}])
    assert [x.activity.snippet for x in N.review(R.reviews(spark, v, pulls), "o/r").collect()] == ["[APPROVED] fine"]


def test_tasks(spark, tmp_path):
    t = put(tmp_path / "t.json", [{"id": "t1", "name": "Fix", "description": None, "status": {"status": "In  Progress"}, "creator": {"id": "1", "username": "ann"}, "date_updated": "1700000000000", "url": "u"}])
    (r,) = N.task(R.tasks(spark, t, 1600000000000), "L").collect()
    assert [(x.name, x.tier) for x in r.topics] == [("in-progress", "ephemeral")] and r.activity.timestamp is not None
    c = put(tmp_path / "c.json", [{"id": "c1", "comment_text": "done", "user": {"id": "1", "username": "ann"}, "date": "1700000000000", "task_id": "t1"}, {"id": "c2", "comment_text": "x", "resolved": True}, {"id": "c3", "comment_text": "  "}])
    assert [x.activity.parent_id for x in N.task_comment(R.task_comments(spark, c), "L").collect()] == ["t1"]
    s = put(tmp_path / "s.json", [{"id": "s1", "task_id": "t1", "field": "status", "before": "Open", "after": "In Review", "user": {"id": "1", "username": "a"}, "date": "1700000000000"}, {"id": "s2", "field": "name"}])
    (r,) = N.status_change(R.status_changes(spark, s), "L").collect()
    assert [x.name for x in r.topics] == ["open", "in-review"]
    d = put(tmp_path / "d.json", [{"id": "d", "name": "Plan", "content": "#q1", "creator": "ann", "date_updated": "1700000000000"}])
    assert N.doc(R.task_docs(spark, d), "S").first().topics[0].name == "q1"


def test_calendar(spark, tmp_path):
    ics = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:1\r\nSUMMARY:Long\r\n  name\r\nDTSTART;TZID=UTC:20240105T100000Z\r\nORGANIZER:mailto:a@b.c\r\nATTENDEE;CN=x:mailto:d@e.f\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:2\r\nDTSTART;VALUE=DATE:20240301\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nSUMMARY:no uid\r\nDTSTART:20240105\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:3\r\nDTSTART:soon\r\nEND:VEVENT\r\n"
    (tmp_path / "a.ics").write_bytes(ics.encode())
    ev = R.calendar(spark, str(tmp_path / "a.ics"))
    assert {(e.uid, e.summary, str(e.start)) for e in ev.collect()} == {("1", "Long name", "2024-01-05 10:00:00"), ("2", None, "2024-03-01 00:00:00")}
    assert R.calendar(spark, str(tmp_path / "a.ics"), F.lit("2024-02-01").cast("timestamp")).count() == 1
    assert {r.person.person_key for r in N.event(ev, "owner").collect()} == {"apple-calendar:a@b.c", "apple-calendar:owner"}


def test_posts_sessions_memory(spark, tmp_path):
    p = put(tmp_path / "p.json", [{"id": "1", "text": "hey @Ann_b https://t.co/x", "created_at": "2024-01-01T00:00:00Z", "author_id": "9", "author_username": "z", "in_reply_to_id": "0", "urls": ["https://t.co/x", "https://y"]}])
    (r,) = N.post(R.posts(spark, p, "2023-01-01")).collect()
    assert r.mentions == ["ann_b"] and r.urls == ["https://t.co/x", "https://y"] and r.activity.parent_id == "0" and r.activity.kind == "reply"
    d = tmp_path / "s"
    d.mkdir()
    put(d / "a.jsonl", [{"type": "user", "sessionId": "s1", "timestamp": "2024-01-01T00:00:00Z", "cwd": "/home/me-proj", "gitBranch": "main", "message": {"role": "user", "content": "fix src/a/b.py"}}, {"type": "assistant", "timestamp": "2024-01-01T00:10:29Z", "message": {"role": "assistant", "content": [{"type": "text", "text": "ok src/a/b.py and c/d.ts"}, {"type": "tool", "text": "no"}]}}, {"type": "user", "timestamp": "2024-01-01T00:10:30Z", "message": {"content": "thanks"}}])
    put(d / "b.jsonl", [{"type": "assistant", "timestamp": "2024-01-01T00:00:00Z", "message": {"content": "alone"}}])
    s = R.sessions(spark, str(d))
    (x,) = s.collect()
    assert x.user_texts == ["fix src/a/b.py", "thanks"] and x.assistant_texts == ["ok src/a/b.py and c/d.ts"] and x.branch == "main"
    (m,) = R.session_metrics(s).collect()
    assert (m.summary, m.files, m.minutes) == ("fix src/a/b.py", 2, 11)
    (r,) = N.session(s).collect()
    assert r.activity.message_count == 3 and "Last request: thanks" in r.activity.snippet
    assert s.select(N.transcript().alias("t")).first().t.startswith("User: fix src/a/b.py\nAssistant: ok")
    mem = spark.createDataFrame([("c", "decision", ["A "], "2024-01-01"), ("d", "other", [], "2024-01-01")], "content string, kind string, topics array<string>, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    (r,) = N.memory(mem).collect()
    assert r.activity.source_id.startswith("1704067200000-") and r.topics[0].name == "a"


def test_logs_and_manifests(spark, tmp_path):
    (tmp_path / "repo.log").write_text("abcdef1|ann|2024-01-02 10:00:00|msg | with bar\n 2 files changed, 3 insertions(+), 1 deletion(-)\n\nabc|x|2024-01-01|short\n\nabcdef2|bob|2024-01-03 10:00:00|two")
    assert [(c.sha, c.files_changed, c.insertions, c.deletions, c.message) for c in R.commits(spark, str(tmp_path / "repo.log")).orderBy("date").collect()] == [("abcdef1", 2, 3, 1, "msg | with bar"), ("abcdef2", 0, 0, 0, "two")]
    (tmp_path / "br.txt").write_text("main|0|0\ndev|2|1\n")
    assert [(b.name, b.ahead, b.is_default) for b in R.branches(spark, str(tmp_path / "br.txt")).orderBy("name").collect()] == [("dev", 2, False), ("main", 0, True)]
    m = tmp_path / "m"
    for proj, files in {"web": {"package.json": '{"dependencies": {"react": "^18"}, "devDependencies": {"react": "1", "jest": "29"}}', "a.ts": "x", "b.ts": "y", "c.py": "z"}, "api": {"requirements.txt": "flask==2.0\n# no\nnumpy\n", "go.mod": "module x\nrequire (\n\tgithub.com/a/b v1.2.3\n)\n", "Cargo.toml": '[dependencies]\nserde = "1.0"\n', "m.py": "x"}}.items():
        (m / proj).mkdir(parents=True)
        for n, t in files.items():
            (m / proj / n).write_text(t)
    deps = R.dependencies(spark, str(m))
    assert {(d.project, d.ecosystem, d.name, d.is_dev) for d in deps.collect()} == {("web", "npm", "react", False), ("web", "npm", "jest", True), ("api", "pypi", "flask", False), ("api", "pypi", "numpy", False), ("api", "go", "github.com/a/b", False), ("api", "cargo", "serde", False)}
    assert {(p.project, p.language, p.framework) for p in R.projects(spark, str(m), {"next": "Next.js", "react": "React"}, deps).collect()} == {("web", "TypeScript", "React"), ("api", "Python", None)}
    (tmp_path / "l.json").write_text('[{"canonical": "person:ann", "aliases": ["a:1", "b:2"]}]')
    assert R.manual_links(spark, str(tmp_path / "l.json")).count() == 2


def test_damaged_lines_and_all_commits(spark, tmp_path):
    p = put(tmp_path / "c.json", [{"type": "message", "user": "U1", "text": "a", "ts": "1"}, "{broken", "not json"])
    assert R.lines(spark, p, R.CHAT).count() == 1
    assert [(r.file, r.line) for r in R.damaged(spark, p, R.CHAT).orderBy("line").collect()] == [("c.json", "not json"), ("c.json", "{broken")]
    (tmp_path / "repo.log").write_text("\n\n".join(f"{i:07d}|ann|2024-01-02 10:00:{i % 60:02d}|m" for i in range(700)))
    assert R.commits(spark, str(tmp_path / "repo.log")).count() == 700
    assert R.commits(spark, str(tmp_path / "repo.log"), 500).count() == 500
