import pytest

from talkgrain.llm import languages as L

TEXTS = {
    "en": ["The group wants to keep the tickets for later and nobody told us why.", "Does anyone know when the meeting starts on Friday?", "It took a long time to repair the old bridge near the river.", "We still need to visit the harbour before noon."],
    "de": ["Die Gruppe möchte die Karten erst später ansehen und niemand weiß warum.", "Weiß jemand, wann die Sitzung am Freitag beginnt?", "Es hat lange gedauert, die alte Brücke am Fluss zu reparieren.", "Wir müssen den Hafen noch vor dem Mittag besuchen."],
    "fr": ["Le groupe veut garder les billets pour plus tard et personne ne sait pourquoi.", "Quelqu'un sait quand commence la réunion de vendredi ?", "Il a fallu beaucoup de temps pour réparer le vieux pont près de la rivière.", "Il faut encore visiter le port avant midi."],
    "es": ["El grupo quiere guardar los billetes para luego y nadie sabe por qué.", "¿Alguien sabe cuándo empieza la reunión del viernes?", "Nos llevó mucho tiempo reparar el viejo puente junto al río.", "Todavía hay que visitar el puerto antes del mediodía."],
    "ru": ["Группа хочет оставить билеты на потом, и никто не знает почему.", "Кто знает, когда начинается встреча в пятницу?", "Ушло много времени, чтобы починить старый мост у реки.", "Нам ещё надо посетить порт до обеда."],
    "zh": ["小组想把票留到以后，没有人知道为什么。", "有人知道周五的会议什么时候开始吗？", "花了很长时间才把河边的旧桥修好。", "我们中午前还要去港口看看。"],
}


@pytest.fixture(scope="module")
def model():
    texts = [(t, lang) for lang, ts in TEXTS.items() for t in ts for _ in range(6)]
    return L.fit([t for t, _ in texts], [x for _, x in texts], L.Params())


def test_codewords_are_far_apart():
    code = L.codewords(15)
    assert min((code[i] != code[j]).sum() for i in range(6) for j in range(i)) >= 7


def test_assign(spark, model):
    rows = [(i, t) for i, t in enumerate(t for ts in TEXTS.values() for t in ts)]
    mixed = TEXTS["en"][0] + " " + TEXTS["ru"][0] + " / " + TEXTS["zh"][2]
    rows += [(100, mixed), (101, None), (102, ""), (103, "!!! 12"), (104, TEXTS["de"][2] * 3000)]
    got = {r["id"]: r for r in L.assign(spark.createDataFrame(rows, "row_id long, content string"), "row_id", "content", model).collect()}
    want = [lang for lang, ts in TEXTS.items() for _ in ts]
    assert [got[i]["lang"] for i in range(len(want))] == want
    assert [s["lang"] for s in got[100]["segments"]] == ["en", "ru", "zh"]
    assert all(got[i]["lang"] is None and got[i]["segments"] == [] for i in (101, 102, 103))
    assert got[101]["ambiguous"] is None and not got[104]["ambiguous"] and not any(s["ambiguous"] for s in got[100]["segments"])
    assert got[104]["lang"] == "de" and 0 < got[104]["confidence"] <= 1


def test_labels(spark):
    from pyspark.sql import functions as F

    labels = ["en", "EN", " en-GB ", "zho", "zh_CN", "deu", "und", "", None, "??", "english", "fr-CA"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(labels)), "i int, l string").orderBy("i").select(L.label_code(F.col("l"))).collect()]
    assert got == ["en", "en", "en", "zh", "zh", "de", None, None, None, None, None, "fr"]


def test_held_out(messages):
    rows = [r for r in L.message_languages(messages).collect() if r["label"] and r["lang"] and r["letters"] >= 20]
    right = sum(any(s["lang"] == r["label"] for s in r["segments"]) for r in rows)
    assert right > 0.85 * len(rows)  # labels themselves are wrong in some rows


def test_found_on_empty(messages):
    assert L.found(messages.limit(0)).collect() == []


def test_ambiguous(spark, model):
    rows = [(1, "ok la"), (2, "Die Gruppe möchte die Karten erst später ansehen. Ok!"), (3, "no de la en")]
    got = {r["id"]: r for r in L.assign(spark.createDataFrame(rows, "row_id long, content string"), "row_id", "content", model).collect()}
    assert got[1]["ambiguous"] and got[3]["ambiguous"] and not got[2]["ambiguous"]
    assert [s["ambiguous"] for s in got[1]["segments"]] == [True] and [s["ambiguous"] for s in got[2]["segments"]] == [False]


def test_codewords_decide_for_every_script(model):
    """Each language's sentences are nearest to its own codeword without any rule about scripts."""
    for lang, texts in TEXTS.items():
        which, conf, gap, _, _ = L._decide(texts, model)
        assert [L.LANGUAGES[i] for i in which] == [lang] * len(texts) and (gap > 0).all()


def test_found_is_as_defined(messages):
    got = L.found(messages)
    assert got.schema.simpleString() == "struct<row_id:bigint,lang:string>"
    rows = got.collect()
    assert {r["lang"] for r in rows} == set(L.LANGUAGES) and len(rows) == len(set(rows))
