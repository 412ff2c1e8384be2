import pytest

from talkgrain.llm import personal as P

SENDERS = [f"{f} {s}" for f in ("Anna", "Boris", "Clara", "Дарья") for s in ("Lindberg", "Sandberg", "Holmberg", "Petrov", "Ivanov", "Sidorov")] + ["李小明", "王小明", "李望秋", "王望秋", "Kestrel News", "Falcon News", "Robin News", "Heron News", "bot", None, ""]


@pytest.fixture(scope="module")
def finder():
    return P.Finder(P.learn(SENDERS))


@pytest.mark.parametrize("text,kinds", [
    ("Write to a.b+c@site.example now", ["email"]), ("mail x_y [at] site.example", ["email"]), ("mail ann dot lee at site dot example", ["email"]), ("see @some_bot there", []),
    ("Call me on +44 20 7946 0452 please", ["phone"]), ("Text (846) 555-0128 now", ["phone"]), ("Appelez-moi au 01 99 00 04 52 ce soir", ["phone"]), ("Звоните мне +7 (000) 541-86-77", ["phone"]), ("打我电话+86 100 8047 7729就行", ["phone"]), ("tel ０７７００ ９００５９２", ["phone"]),
    ("Ticket 2025-04-18 is closed", []), ("Parcel code KX57313016048 got lost", []), ("It cost 868,00 today", []), ("See 8993/32 in the log", []), ("version v7.19.15", []),
    ("social number is 919-85-9408", ["idnum"]), ("我的证件号码：992522198203115023", ["idnum"]), ("Pasaporte 000.176.370-44", ["idnum"]), ("Мой паспорт 0045 № 313850", ["idnum"]), ("Passport QQ 84 58 16 C", ["idnum"]),
    ("I moved to 74 Harrow Lane, Lavenoy", ["address"]), ("Ich wohne jetzt Kranichweg 21, Ostmere", ["address"]), ("Paket bitte an Am Mühlgraben 25 in Torbingen", ["address"]), ("J'habite 80 rue des Tisserands-Bleus", ["address"]), ("va a calle Olmo Pardo 25, 5º B", ["address"]), ("ул. Кедровая, д. 103, кв. 14", ["address"]), ("我搬到柳桥大街60弄1号楼了", ["address"]),
    ("Ask Anna Lindberg about it", ["name"]), ("Ask Lindberg, Anna about it", ["name"]), ("I saw Boris K. Petrov there", ["name"]), ("请找李望秋。", ["name"]), ("Best, Clara", []), ("thx Clara Can somebody", []), ("Kestrel News is down", []), ("Аnnа Lindberg signed", ["name"]), ("An​na Lind­berg", ["name"]),
])
def test_spans(finder, text, kinds):
    assert [s[0] for s in finder.spans(text)] == kinds


def test_validators():
    assert P.luhn("4539578763621486") and not P.luhn("4539578763621487")
    assert P.mod11_china("11010519491231002X") and not P.mod11_china("110105194912310021")
    assert P.mod97_iban("GB82 WEST 1234 5698 7654 32") and not P.mod97_iban("GB82 WEST 1234 5698 7654 33")
    assert P.mod23_spain("12345678Z") and P.mod23_spain("X-1234567-L") and not P.mod23_spain("12345678A")
    assert P.mod11_brazil("52998224725") and not P.mod11_brazil("52998224726")


def test_mask(spark, finder):
    rows = [(1, "Ask Anna Lindberg or a@b.example", "Anna Lindberg 07700 900829", "x"), (2, None, "", "x"), (3, "", None, "x"), (3, "", None, "x"), (4, "ok " * 100_000 + "mail a@b.example", "bot", "x")]
    df = spark.createDataFrame(rows, "row_id long, content string, sender string, t0 string")
    got = sorted(P.mask(df, "row_id", ["content", "sender"], finder.names).collect())
    assert len(got) == 5
    by = {r["row_id"]: r for r in got}
    assert by[1]["content"] == "Ask [NAME] or [EMAIL]" and by[1]["sender"] == "Anna Lindberg [PHONE]"
    assert by[2]["content"] is None and by[2]["content_spans"] is None and by[2]["sender"] == ""
    assert by[4]["content"].endswith("mail [EMAIL]")
    for r in got:
        for s in r["content_spans"] or []:
            assert 0 <= s["start"] < s["end"]


def test_spans_lie_in_the_original(finder):
    text = "a​ Call me on +44 20​ 7946 0452 now"
    (kind, lo, hi, _), = finder.spans(text)
    assert kind == "phone" and text[lo:hi].startswith("+44") and text[lo:hi].endswith("0452")


def test_without_senders(messages):
    assert P.found(messages.limit(0)).collect() == []


def test_names_of_all_senders(spark):
    word = lambda i: "Q" + "".join(chr(97 + i // 26**k % 26) for k in range(4))
    senders = SENDERS + [f"{word(i)} {word(i + 300_000)}" for i in range(45_000)]
    senders += [f"{f} {s}" for f in ("Zelda", "Jean-Luc", "Mei") for s in ("Li", "Marchetti", "Ó-Lindberg", "Roth-Sandberg")] + ["李明", "欧阳望秋", "欧阳小明", "欧阳修", "天空", "Anna Holmberg-Li - night shift"]
    names = P.train(spark.createDataFrame([(s,) for s in senders], "sender string"))
    assert names == P.learn(senders)
    assert {"anna", "zelda", "jean-luc", "mei"} <= names.first and "qaaaa" not in names.first
    assert names.han_whole == {"李明", "欧阳修"}
    finder = P.Finder(names)
    for text, name in [("Ask Zelda Marchetti now", "Zelda Marchetti"), ("Ask Jean-Luc Lindberg now", "Jean-Luc Lindberg"), ("Li, Mei wrote", "Li, Mei"), ("请找李明吧", "李明"), ("请找欧阳修吧", "欧阳修"), ("请找欧阳小明吧", "欧阳小明")]:
        assert [text[lo:hi] for _, lo, hi, _ in finder.spans(text)] == [name]
    assert finder.spans("天空很蓝") == []


def test_found(spark, finder):
    rows = [(1, "Ask Anna Lindberg or a@b.example or c@d.example", "Anna Lindberg 07700 900829"), (2, None, ""), (3, "", None), (4, "nothing here", "bot"), (5, "mail x@y.example", None)]
    masked = P.mask(spark.createDataFrame(rows, "row_id long, content string, sender string"), "row_id", ["content", "sender"], finder.names)
    got = P.kinds_found(masked, "row_id", ["content", "sender"])
    assert got.schema.simpleString() == "struct<row_id:bigint,field:string,kind:string>"
    assert sorted(map(tuple, got.collect())) == [(1, "content", "email"), (1, "content", "name"), (1, "sender", "phone"), (5, "content", "email")]


def test_found_in_messages(messages):
    got = P.found(messages)
    assert got.schema.simpleString() == "struct<row_id:bigint,field:string,kind:string>"
    seen = {(r["field"], r["kind"]) for r in got.collect()}
    assert {f for f, _ in seen} == {"content", "sender"} and {k for _, k in seen} <= set(P.KINDS)
    assert {("content", k) for k in P.KINDS} <= seen and ("sender", "phone") in seen and ("sender", "name") not in seen


def planted(rng):
    """(kind, text): personal data of random values in carrier sentences that were not used to write the patterns."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3)).capitalize()
    first, last = rng.choice(["Anna", "Boris", "Clara"]), rng.choice(["Lindberg", "Sandberg", "Holmberg"])
    china = digits(17)
    nir = rng.choice("12") + digits(12)
    dni = digits(8)
    value = {
        "email": rng.choice([f"{word().lower()}.{word().lower()}@{word().lower()}.example", f"{word().lower()}_{digits(2)} [at] {word().lower()}.example", f"{word().lower()}+x@mail.{word().lower()}.example"]),
        "phone": rng.choice([f"+44 20 {digits(4)} {digits(4)}", f"+49 30 {digits(7)}", f"+7 (9{digits(2)}) {digits(3)}-{digits(2)}-{digits(2)}", f"({digits(3)}) 555-{digits(4)}"]),
        "idnum": rng.choice([china + next(c for c in "0123456789X" if P.mod11_china(china + c)), f"{nir}{97 - int(nir) % 97:02d}", dni + "TRWAGMYFPDXBNJZSQVHLCKE"[int(dni) % 23]]),
        "address": rng.choice([f"{rng.randint(1, 400)} {word()} Street", f"{word()}straße {rng.randint(1, 90)}", f"{rng.randint(1, 90)} rue de {word()}", f"ул. Лесная, д. {rng.randint(1, 90)}", f"长安大街{rng.randint(1, 900)}号"]),
        "name": f"{first} {last}",
    }
    around = ["We met last week; {} was on the form, I think.", "Bitte notieren: {} – danke!", "Merci de garder {} pour demain.", "Apunta esto: {}, por favor.", "Запишите, пожалуйста: {} и всё.", "（{}）记一下"]
    kind = rng.choice(P.KINDS)
    return kind, rng.choice(around).format(value[kind])


def test_recall_of_each_kind_on_planted_values(finder):
    import random
    from collections import Counter

    rng, seen, right = random.Random(8), Counter(), Counter()
    for _ in range(3000):
        kind, text = planted(rng)
        seen[kind] += 1
        right[kind] += kind in {s[0] for s in finder.spans(text)}
    shares = {k: right[k] / seen[k] for k in P.KINDS}
    print(shares)
    assert min(shares.values()) >= 0.9, shares
