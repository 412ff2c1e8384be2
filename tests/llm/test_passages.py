import re

import numpy as np

from talkgrain.llm import passages as P


def count(text):
    return P.passages([text])[3].tolist()[0]


def test_sentences():
    assert count("[14:27] Dora E. Lundo: One here. Two there!\n- Three of them\n\n12:30") == 3
    assert count("第一句。第二句！第三句") == 3
    assert count(None) == count("") == count("!! 12. 13.") == 0
    assert count("K. Smith left. He said “no.” Then he ran / she too • all") == 5
    assert [x.tolist() for x in P.passages([])] == [[], [], [], []]


def test_terms_belong_to_their_sentences():
    terms, n, whose, sentences = P.passages(["alpha beta. gamma 12 a1 delta", None, "你好吗。beta"])
    assert n.tolist() == [2, 2, 2, 1] and whose.tolist() == [0, 0, 2, 2] and sentences.tolist() == [2, 0, 2]
    assert terms[1] == terms[6] and len(set(terms.tolist())) == 6
    assert P.passages(["BETA"])[0][0] == terms[1]


def test_longer_than_the_tables():
    words = ["alpha", "beta", "gamma", "x" * (3 * P.PASS), "tail"]
    text = " ".join(words * 2) + " " + "alpha beta " * P.PASS
    terms = P.passages([text])[0]
    assert len(terms) == 10 + 2 * P.PASS and len(set(terms.tolist())) == 5
    assert np.array_equal(P.passages(["alpha beta"])[0], terms[-2:])


def test_slices_cover_a_batch():
    texts = [None, "", "a" * (P.PASS + 5), "b", "c" * P.PASS, "d"]
    assert sum((texts[s] for s in P.slices(texts)), []) == texts


def test_words_as_a_pattern_finds_them():
    text = "Résumé, naïve—Straße 3rd x_y über-all Москва ok"
    want = [w for w in re.findall(r"[^\W_]+", text) if not re.search(r"\d", w)]
    assert len(P.passages([text])[0]) == len(want)
