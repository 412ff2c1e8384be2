from talkgrain.llm import lookalikes as la

CASES = {
    "ＡＢ１ ok": ("AB1 ok", 1), "éte": ("éte", 2), "a​b­c": ("abc", 4), "a b　c": ("a b c", 8), "ﬁle ㎏": ("file kg", 16),
    "Yuѕuf": ("Yusuf", 32), "Eгop": ("Егор", 32), "Νоor": ("Noor", 32), "plain": ("plain", 0), "": ("", 0), "，。！（full）": ("，。！（full）", 0),
    "👩‍💻 ok": ("👩‍💻 ok", 0), "👩‍👩‍👧‍👦": ("👩‍👩‍👧‍👦", 0), "a‍b": ("ab", 4), "Привет world": ("Привет world", 0), "№ 5": ("№ 5", 0), "n​̃": ("ñ", 6), "a\tb": ("a b", 8),
}


def test_cases(spark):
    rows = [(i, t, None, "clash") for i, t in enumerate(CASES)] + [(99, None, "ｘ", "clash"), (99, None, "ｘ", "clash")]
    df = spark.createDataFrame(rows, "row_id long, content string, sender string, t0 string")
    got = {r["row_id"]: r for r in la.normalize(df, "row_id", ["content", "sender"]).collect()}
    for i, (form, kinds) in enumerate(CASES.values()):
        assert (got[i]["content"], got[i]["content_kinds"]) == (form, kinds), list(CASES)[i]
        assert got[i]["sender"] is None and got[i]["sender_kinds"] is None
    assert (got[99]["content"], got[99]["sender"], got[99]["sender_kinds"]) == (None, "x", 1)
    found = sorted(map(tuple, la.found(df, "row_id", ["content", "sender"]).collect()))
    assert found == [(i, "content") for i, (_, k) in enumerate(CASES.values()) if k] + [(99, "sender")] * 2
    assert la.found(df.limit(0), "row_id", ["content"]).collect() == []


def test_long_text(spark):
    df = spark.createDataFrame([(1, "ａ" * 500_000)], "row_id long, content string")
    assert la.normalize(df, "row_id", ["content"]).first()["content"] == "a" * 500_000


FORMS = {"𝐇𝐞𝐥𝐥𝐨 ⓗⓘ": "Hello hi", "ﾊﾝ ﾊﾞ": "ハン バ", "x² and ½": "x2 and 1⁄2", "①②": "12", "⼀字": "一字", "㍿": "株式会社", "№ 5 … “ok”": "№ 5 … “ok”", "５＋５": "5＋5"}


def test_compatibility_forms(spark):
    df = spark.createDataFrame(list(enumerate(FORMS)), "row_id long, content string")
    got = {r["row_id"]: r["content"] for r in la.normalize(df, "row_id", ["content"]).collect()}
    assert [got[i] for i in range(len(FORMS))] == list(FORMS.values())


def test_letters_as_unicode_maps_them(spark):
    """Every letter, digit and symbol with a compatibility form comes out as NFKC gives it, alone and in a batch with all others."""
    import unicodedata

    one, many = la.compatible()
    chars = sorted({*one, *many})
    assert len(chars) > 3000
    df = spark.createDataFrame([(i, f"- {c} -") for i, c in enumerate(chars)], "row_id long, content string")
    got = {r["row_id"]: r["content"] for r in la.normalize(df, "row_id", ["content"]).collect()}
    wrong = [(c, got[i]) for i, c in enumerate(chars) if got[i] != unicodedata.normalize("NFC", "- " + unicodedata.normalize("NFKC", c) + " -") and unicodedata.normalize("NFKC", got[i]) != unicodedata.normalize("NFKC", f"- {c} -")]
    assert not wrong
    assert la.normalize(df, "row_id", ["content"]).where("content_kinds > 0").count() <= 40  # mostly no kind of problem 5
