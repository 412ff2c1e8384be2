"""The fold of changes against a replay, the delivery store, the message store, streams and commands."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talkgrain import config
from talkgrain.commands import CommandError, Frontdesk, addressed, allowed, arguments, button
from talkgrain.operators import chats as chat_list
from talkgrain.operators import deliveries
from talkgrain.operators.changes import fold, from_deletes, from_edits, from_messages
from talkgrain.schema import CHANGES, SchemaMismatch
from talkgrain.sources.store import HistoryExists, MessageStore
from talkgrain.state import State
from talkgrain.streaming import live

T0 = dt.datetime(2024, 1, 1)


def replay(log):
    out = {}
    for seq, op, chat, msg, sender, content, at in sorted(log):
        if op == "new":
            out[chat, msg] = (sender, content, at)
        elif op == "edit" and (chat, msg) in out:
            s, _, t = out[chat, msg]
            out[chat, msg] = (s, content, t)
        elif op == "delete":
            out.pop((chat, msg), None)
    return out


def frame(spark, log):
    return spark.createDataFrame(log, CHANGES)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["new", "edit", "delete"]), st.integers(1, 2), st.integers(1, 3)), max_size=40))
def test_fold(spark, events):
    log = [(i, op, c, m, f"s{i}" if op == "new" else None, None if op == "delete" else f"t{i}", T0 + dt.timedelta(hours=i) if op == "new" else None) for i, (op, c, m) in enumerate(events)]
    got = {(r["chat_id"], r["msg_id"]): (r["sender"], r["content"], r["post_time"]) for r in fold(frame(spark, log)).collect()}
    assert got == replay(log)


def test_feeds(spark):
    new = spark.createDataFrame([(1, 5, -1001234567890, " a\nb ", T0, ("A", None)), (2, 6, None, "x", T0, None), (3, 7, 0, "x", T0, None), (4, 8, 9, " \t", T0, None), (5, 9, 9, None, T0, None)], "seq long, id long, chat_id long, raw_text string, sent_at timestamp_ntz, sender struct<first_name:string,last_name:string>")
    assert [(r["chat_id"], r["content"], r["sender"]) for r in from_messages(new).collect()] == [(1234567890, "a b", "A")]
    edits = spark.createDataFrame([(1, -9, 5, "x"), (2, 9, 5, " ")], "seq long, chat_id long, id long, raw_text string")
    assert [(r["chat_id"], r["content"]) for r in from_edits(edits).collect()] == [(9, "x")]
    gone = spark.createDataFrame([(1, 9, [1, 1, 2]), (2, None, [3]), (3, 9, []), (4, 9, None)], "seq long, chat_id long, deleted_ids array<long>")
    assert sorted(r["msg_id"] for r in from_deletes(gone).collect()) == [1, 2]


MESSAGES = "row_id long, batch_id int, ingested_at timestamp_ntz, url string, post_time timestamp_ntz, share string, w string"


def deliver(spark, rows):
    return spark.createDataFrame([(i, b, T0 + dt.timedelta(days=40 * b), u, t, "clash", "clash") for i, b, u, t in rows], MESSAGES)


def test_deliveries(spark, tmp_path):
    late = T0 + dt.timedelta(days=1)
    rows = [(1, 1, "https://h/c/1/1", T0), (2, 1, "HTTPS://H/c/1/1/", late), (3, 2, "https://h/c/1/1#", late), (4, 9, "https://h/c/1/1", None),
            (5, 1, "https://h/c/1/2", None), (6, 9, "https://h/c/1/2", None), (7, 1, None, T0), (8, 9, None, T0), (9, 9, "nonsense", T0), (10, 9, "https://h/c/2/1", T0)]
    df = deliver(spark, rows)
    got = sorted(r[0] for r in deliveries.dropped(df, str(tmp_path / "a"), incoming_batches=3).collect())
    assert got == [1, 3, 4, 6]
    assert deliveries.dropped(df.limit(0), str(tmp_path / "b")).collect() == []


def test_only_affected_partitions(spark, tmp_path):
    store = deliveries.DeliveryStore(spark, str(tmp_path / "s"))
    assert store.read() is None
    store.upsert(deliveries.keyed(deliver(spark, [(1, 0, "https://h/c/1/1", T0), (2, 1, "https://h/c/1/2", T0), (3, 2, "https://h/c/1/3", T0)])))
    before = store.manifest()["parts"]
    touched = store.upsert(deliveries.keyed(deliver(spark, [(4, 5, "https://h/c/1/2", T0 + dt.timedelta(1))])))
    after = store.manifest()["parts"]
    assert touched == ["2024-02"] and [k for k in after if before.get(k) != after[k]] == ["2024-02"]
    again = store.upsert(deliveries.keyed(deliver(spark, [(4, 5, "https://h/c/1/2", T0 + dt.timedelta(1))])))  # a batch run twice
    assert again == touched
    store.vacuum()
    assert sorted((r["msg"], r["row_id"]) for r in store.read().collect()) == [(1, 1), (2, 4), (3, 3)]


def test_two_writers_lose_no_upsert(spark, tmp_path):
    one, two = (deliveries.DeliveryStore(spark, str(tmp_path / "s"), bucket=2, segments=2) for _ in range(2))
    one.upsert(deliveries.keyed(deliver(spark, [(i, 0, f"https://h/c/1/{i}", T0) for i in range(1, 9)])))
    made, other = one._combined, []

    def slow(new, found):
        if not other:  # the other writer commits between this one's reading and its commit
            other.append(two.upsert(deliveries.keyed(deliver(spark, [(20, 3, "https://h/c/1/2", T0 + dt.timedelta(1)), (21, 3, "https://h/c/1/21", T0)]))))
        return made(new, found)

    one._combined = slow
    one.upsert(deliveries.keyed(deliver(spark, [(30, 4, "https://h/c/1/2", T0 + dt.timedelta(2)), (31, 4, "https://h/c/1/31", T0)])))
    kept = {r["msg"]: r["row_id"] for r in one.read().collect()}
    assert kept == {**{i: i for i in range(1, 9)}, 2: 30, 21: 21, 31: 31}


def test_lookups_read_the_buckets_of_their_identifiers(spark, tmp_path):
    store = deliveries.DeliveryStore(spark, str(tmp_path / "s"), bucket=10, segments=3)
    read = []
    for n in (200, 800):
        store.upsert(deliveries.keyed(deliver(spark, [(n * 10 + i, 0, f"https://h/c/{n}/{i}", T0) for i in range(n)])))
        ids = deliveries.winners(deliveries.keyed(deliver(spark, [(9, 0, "https://h/c/200/5", T0), (10, 0, "https://h/c/7/7", T0)])))
        read.append(store.lookup(ids, store.manifest()["index"]).count())
    assert max(read) <= 120 and len(store.manifest()["index"]) == 2  # not in proportion to the store
    for k in range(3):
        store.upsert(deliveries.keyed(deliver(spark, [(90_000 + k, 0, f"https://h/c/9/{k}", T0)])))
    assert len(store.manifest()["index"]) <= 3
    assert store.lookup(ids, store.manifest()["index"]).where("share = 200 AND msg = 5").count() == 1


def test_appends_of_two_writers_stay(spark, tmp_path):
    one, two = (MessageStore(spark, str(tmp_path / "m")) for _ in range(2))
    one.append(frame(spark, [(1, "new", 7, 1, "a", "x", T0)]))
    read = one.log()
    two.append(frame(spark, [(2, "new", 7, 2, "a", "y", T0)]))
    one._replace(one._folders()[:1], read)  # a compaction of what was there before
    assert sorted(r["msg_id"] for r in two.live().collect()) == [1, 2]


@pytest.fixture
def store(spark, tmp_path):
    return MessageStore(spark, str(tmp_path / "store"))


FEED = "seq long, id long, chat_id long, raw_text string, sent_at timestamp_ntz, sender struct<first_name:string,last_name:string>"


def feed(spark, n=5, chat=-1000000000007):
    return spark.createDataFrame([(i, i, chat, f"ferry {i} <x>", T0 + dt.timedelta(hours=i), ("Ann", "Lee")) for i in range(1, n + 1)], FEED)


def test_store(spark, store):
    store.backfill(feed(spark), 7)
    assert store.count(chat_id=7) == 4  # bounds are left out, so id 1 is
    with pytest.raises(HistoryExists):
        store.backfill(feed(spark), 7)
    store.backfill(feed(spark, 8), 7, min_id=4)
    assert store.count() == 7
    store.append(frame(spark, [(99, "delete", 7, 3, None, None, None), (100, "edit", 7, 4, None, "new text", None), (101, "edit", 7, 77, None, "none", None)]))
    assert store.count() == 6 and store.get("https://chat.example/c/7/4").first()["content"] == "new text"
    before = sorted(map(tuple, store.live().collect()))
    store.compact()
    assert sorted(map(tuple, store.live().collect())) == before
    store.clear_chats(spark.createDataFrame([(7,), (8,)], "chat_id long"))
    assert store.count() == 0
    with pytest.raises(SchemaMismatch):
        from talkgrain.schema import check

        check(spark.range(1).toDF("x"), CHANGES)


def test_stream(spark, store, tmp_path):
    rows = [(1, "new", 7, 1, "a", "x", T0), (2, "new", 8, 1, "a", "x", T0), (3, "edit", 7, 1, None, "y", None)]
    frame(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    watched = lambda: spark.createDataFrame([(7,)], "chat_id long")
    seen = []
    stream = live.read_changes(spark, str(tmp_path / "in"))
    q = live.follow(stream, store, str(tmp_path / "cp"), watched, progress=lambda k, n: seen.append(n))
    q.awaitTermination(120)
    assert [(r["chat_id"], r["content"]) for r in store.live().collect()] == [(7, "y")] and sum(seen) == 2
    live.arrivals(live.read_changes(spark, str(tmp_path / "in"))).schema


def test_frontdesk(spark, store):
    chats = chat_list.titles(spark.createDataFrame([(7, " Alpha "), (8, "alpha"), (9, None)], "id long, name string"))
    desk = Frontdesk(store, chats, config.Frontend("f", "b", admin=1, page_len=3, no_redis=True))
    assert "empty" in desk.handle("ferry").text
    desk.download(feed(spark, 9), "7")
    reply = desk.handle("ferry", chat=5)
    assert reply.text == "8 results, page 1 of 3" and set(reply.buttons) == {"search_page=2"}
    first = reply.rows.collect()
    assert [r["msg_id"] for r in first] == [9, 8, 7] and "<b>ferry</b> 9 &lt;x&gt;" in first[0]["html"]
    assert [r["msg_id"] for r in desk.press("search_page=3", 5).rows.collect()] == [3, 2]
    assert [r["title"] for r in desk.handle("/chats Al").rows.collect()] == ["Alpha"]
    assert len(desk.handle("/find_chat_id AL", sender=1).rows.collect()) == 2
    assert desk.handle("/nonsense").text.startswith("Unknown") and desk.handle("/searchfoo x").text.startswith("Unknown")
    assert desk.handle("/start") is None and desk.handle(" ") is None
    assert desk.handle("/random").rows.count() == 1
    assert [r["chat_id"] for r in desk.handle("/stat", sender=1).rows.collect()] == [None, 7]
    assert desk.handle("/clear", sender=1).text.startswith("Usage")
    desk.handle("/clear Alpha", sender=1)
    assert store.count() == 0


def test_gates_and_arguments():
    f = config.Frontend("f", "b", admin=1, private_mode=True, private_whitelist=[7], no_redis=True)
    assert allowed(f, 1, None) and allowed(f, 2, -1000000000007) and not allowed(f, 2, 8) and not allowed(f, 2, None)
    assert addressed("hi @bot", True, False, "bot") and not addressed("hi", True, False, "bot")
    assert vars(arguments('--min 3 "a b" -5')) | {} == {"chats": ["a b", "-5"], "min": 3, "max": None}
    for bad in ("--min x", '"open'):
        with pytest.raises(CommandError):
            arguments(bad)
    assert button("search_page=2") == ("search_page", 2)
    with pytest.raises(CommandError):
        button("other=1")
    with pytest.raises(ValueError):
        config.build({"root": "r", "backends": [{"id": "b"}, {"id": "b"}]})
    assert config.host_port("localhost:6379") == ("localhost", 6379)


def test_state(spark, tmp_path):
    s = State()
    s.set("a", 1)
    s.save(spark, str(tmp_path / "kv"))
    assert State.load(spark, str(tmp_path / "kv")).get("a") == "1" and s.get("b") is None


def test_status_limit(spark):
    rows = [(c, 1, "u", "", "x" * 40, T0) for c in range(500)]
    m = spark.createDataFrame(rows, "chat_id long, msg_id long, url string, sender string, content string, post_time timestamp_ntz")
    titles = spark.createDataFrame([(1, "T")], "chat_id long, title string")
    lines = chat_list.status(m, titles, 1000).orderBy("place").collect()
    assert sum(len(r["line"]) + 1 for r in lines) <= 1000 and [r["chat_id"] for r in lines] == [None, *range(len(lines) - 2), None]
    assert lines[0]["line"] == "500 messages in 500 chats" and lines[-1]["line"] == f"and {500 - len(lines) + 2} more chats"
    gone = spark.createDataFrame([(1,), (3,), (3,)], "chat_id long")
    few = chat_list.status(m.where("chat_id < 2"), titles, 1000, gone).orderBy("place").collect()
    assert [r["line"] for r in few][1:4] == ["2 chats excluded", "excluded: T (1)", "excluded: ? (3)"] and [r["chat_id"] for r in few] == [None, None, 1, 3, 0, 1]
    assert [r["line"] for r in chat_list.status(m.limit(0), titles, 1000).collect()] == ["0 messages in 0 chats"]
    assert chat_list.resolve(titles, " T ") == 1 and chat_list.resolve(titles, "-1000000000007") == 7
    with pytest.raises(chat_list.EntityNotFound):
        chat_list.resolve(titles, "none")
    assert chat_list.random_message(m.where(F.lit(False))).collect() == []


def test_all_arrivals_count_late_messages(spark):
    from talkgrain.streaming.live import all_arrivals

    rows = [("new", 1, "2024-03-09 10:00:00"), ("new", 1, "2024-01-01 10:00:00"), ("new", 1, "2024-03-09 11:00:00"), ("edit", 1, "2024-03-09 12:00:00")]
    got = all_arrivals(spark.createDataFrame(rows, "op string, chat_id long, post_time string")).collect()
    assert sorted((str(r["window"]["start"])[:10], r["chat_id"], r["n"]) for r in got) == [("2024-01-01", 1, 1), ("2024-03-09", 1, 2)]


def test_commands_by_feed(spark, tmp_path):
    feeds = {"incoming": feed(spark, 9), "dialogs": spark.createDataFrame([(7, "Alpha & co"), (8, "Beta")], "id long, name string")}
    said = []
    store = MessageStore(spark, str(tmp_path / "d"), from_scratch=True)
    desk = Frontdesk(store, chat_list.titles(feeds["dialogs"].limit(0)), config.Frontend("f", "b", admin=1, no_redis=True, zone="Europe/Berlin"), backend=config.Backend("b", True, [-1000000000008]), feeds=feeds.get, username="grain", log=said.append)
    assert desk.handle("/refresh_chat_names", sender=1).text.startswith("Chat names") and desk.chats.count() == 2
    assert desk.handle("/download_chat", sender=1).text.startswith("Usage")
    import talkgrain.commands as commands

    commands.PROGRESS, kept = 4, commands.PROGRESS
    try:
        assert desk.handle("/download_chat --min 1 7", sender=1).text == "Downloaded 8 messages"
    finally:
        commands.PROGRESS = kept
    assert said == ["7: 4 messages, about 4 left", "7: 8 messages, about 0 left"]
    assert "has messages" in desk.handle("/download_chat 7", sender=1).text
    assert desk.handle("ferry", sender=5, group=True) is None and desk.handle("@grain ferry", sender=5, group=True) is not None
    html = desk.handle("ferry", sender=5).rows.first()["html"]
    assert "[2024-01-01 10:00:00]" in html and "<b>ferry</b>" in html  # an hour on from the time kept
    rows, exclude = desk.taken()
    assert exclude and [r[0] for r in rows.collect()] == [8]
    assert [r["line"] for r in desk.handle("/stat", sender=1).rows.collect()][:3] == ["8 messages in 1 chats", "1 chats excluded", "excluded: Beta (8)"]
    assert "Alpha &amp; co</a>" in desk.handle("/find_chat_id alpha", sender=1).rows.first()["html"]
    from talkgrain.commands import labels

    assert sorted(map(tuple, labels(desk.chats).collect()))[0] == (7, "Alpha & co (7)", "select_chat=7")


def test_command_line(spark, tmp_path, capsys):
    import json

    from talkgrain.__main__ import desks, parser

    a = parser().parse_args(["-c", "-f", "x.json", "--debug"])
    assert a.clear and a.config == "x.json" and a.debug
    (tmp_path / "c.yaml").write_text(json.dumps({"root": str(tmp_path / "root"), "backends": [{"id": "b"}], "frontends": [{"id": "f", "backend": "b", "admin": 1, "no_redis": True}]}))
    conf = config.load(str(tmp_path / "c.yaml"))
    desk = desks(spark, conf)["f"]
    desk.store.append(frame(spark, [(1, "new", 7, 1, "a", "x", T0)]))
    assert desks(spark, conf)["f"].store.count() == 1 and desks(spark, conf, clear=True)["f"].store.count() == 0


def test_shared_folder_is_needed_on_a_cluster(spark):
    from talkgrain import session

    class Conf:
        get = staticmethod(lambda k, d: None)

    class Cluster:
        conf = Conf

        class sparkContext:
            master = "local-cluster[2,1,1024]"

    with pytest.raises(session.NoSharedFolder):
        session.shared_dir(Cluster)


def test_index_prunes(spark, tmp_path):
    from talkgrain.sources.index import SearchIndex

    rows = [(c, m, f"u{c}/{m}", "Ann", "ferry to 搜索引擎" if m % 2 else "night trains", T0 + dt.timedelta(days=20 * m)) for c in (1, 2) for m in range(6)]
    index = SearchIndex(spark, str(tmp_path / "i"))
    assert not index.exists()
    index.write(spark.createDataFrame([*rows, (3, 1, "u", "", "ferry", None)], "chat_id long, msg_id long, url string, sender string, content string, post_time timestamp_ntz"))
    index.vacuum()
    assert index.search("ferry").count() == 7 and index.search("搜索").count() == 6
    got = index.search("ferry AND post_time:[20240101 TO 202402]", [1])
    assert sorted(r["msg_id"] for r in got.collect()) == [1]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PartitionFilters: [isnotnull(month" in plan and "EqualTo(chat_id,1)" in plan.replace("In(chat_id, [1])", "EqualTo(chat_id,1)")
