"""Queries of the subpackage against their SQL, on whole tables; the others by schema and by what their rows must be."""

import pytest

from talkgrain.llm import languages, personal, queries, subjects
from tests.conftest import SF, same

SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, duck, name):
    same(queries.QUERIES[name](spark, SF), duck, queries.ORACLES[name])


def masked(r):
    for f in ("content", "sender"):
        spans = r[f"{f}_spans"]
        if (r[f] is None) != (spans is None) or any(s["kind"] not in personal.KINDS or not 0 <= s["start"] < s["end"] or not 0.6 <= s["score"] <= 1 for s in spans or ()):
            return False
        if any(f"[{s['kind'].upper()}]" not in r[f] for s in spans or ()):
            return False
    return True


def segment(r):
    if r["lang"] is None:
        return r["segment_lang"] is None and r["place"] is None
    return r["lang"] in languages.LANGUAGES and r["segment_lang"] in languages.LANGUAGES and 0 <= r["confidence"] <= 1 and 0 <= r["segment_confidence"] <= 1 and r["segment_text"] and isinstance(r["segment_ambiguous"], bool)


#: Schema, and what holds of each row.
OTHERS = {
    "p3_found": ("row_id:bigint,field:string,kind:string", lambda r: r["field"] in ("content", "sender") and r["kind"] in personal.KINDS and (r["field"], r["kind"]) != ("sender", "name")),
    "p3_masked": (f"row_id:bigint,content:string,content_spans:{SPAN},sender:string,sender_spans:{SPAN}", masked),
    "p4_found": ("row_id:bigint,lang:string", lambda r: r["lang"] in languages.LANGUAGES),
    "p4_segments": ("row_id:bigint,label:string,lang:string,confidence:double,ambiguous:boolean,place:int,segment_lang:string,segment_confidence:double,segment_ambiguous:boolean,segment_text:string", segment),
    "p5_normalized": ("row_id:bigint,content:string,content_kinds:int,sender:string,sender_kinds:int", lambda r: all((r[f] is None) == (r[f"{f}_kinds"] is None) and (r[f"{f}_kinds"] is None or 0 <= r[f"{f}_kinds"] < 64) for f in ("content", "sender"))),
    "p7_regions": ("doc_id:bigint,item_id:bigint,doc_start:int,doc_end:int,item_start:int,item_end:int,edits:int,twelve:boolean", lambda r: min(r["doc_end"] - r["doc_start"], r["item_end"] - r["item_start"]) >= 23 and r["edits"] <= (r["doc_end"] - r["doc_start"] + 1) // 60),
    "p8_mixture": ("doc_id:bigint,source:string,language:string,tokens:bigint,copies:int", lambda r: r["copies"] >= 1 and r["tokens"] >= 0),
    "p8_shares": ("source:string,target_share:double,actual_share:double,tokens:bigint,documents:bigint,most_copies:int", lambda r: 0 <= r["actual_share"] <= 1),
    "p9_found": ("doc_id:bigint,subject:string", lambda r: r["subject"] in subjects.SUBJECTS),
    "p9_make_up": ("subject:string,documents:bigint,share:double", lambda r: r["subject"] in subjects.SUBJECTS and 0 < r["share"] <= 1),
}


def test_all_queries_are_covered():
    assert set(OTHERS) | set(queries.ORACLES) == set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(OTHERS))
def test_rows(spark, duck, name):
    schema, holds = OTHERS[name]
    df = queries.QUERIES[name](spark, SF)
    assert df.schema.simpleString() == f"struct<{schema}>"
    rows = df.collect()
    assert rows and not [r for r in rows if not holds(r)][:3]
    if name in ("p3_found", "p4_found", "p9_found", "p8_mixture"):
        key = df.columns[: -1 if name == "p4_found" else len(df.columns)]
        assert len({tuple(r) for r in rows}) == len(rows) and key
    if name in ("p3_masked", "p5_normalized"):
        assert len(rows) == duck.execute("SELECT count(*) FROM messages").fetchone()[0]
    if name == "p8_mixture":
        most = dict(duck.execute("SELECT source, max_repeats FROM mix_targets").fetchall())
        assert all(r["copies"] <= most[r["source"]] for r in rows) and len({r["doc_id"] for r in rows}) == len(rows)
    if name == "p8_shares":
        assert sum(r["actual_share"] for r in rows) == pytest.approx(1) and {r["source"] for r in rows} == {s for (s,) in duck.execute("SELECT source FROM mix_targets").fetchall()}
