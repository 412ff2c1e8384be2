"""Queries over the test tables by name, and the SQL they must agree with."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgrain import config
from talkgrain.commands import Frontdesk
from talkgrain.functions import ids, text
from talkgrain.functions.analyze import PLAIN, STOP_WORDS, Profile
from talkgrain.operators import changes, deliveries, gates
from talkgrain.operators import chats as chat_list
from talkgrain.operators import search as searching
from talkgrain.schema import CHANGES
from talkgrain.session import read_table, scratch
from talkgrain.sources.index import SearchIndex
from talkgrain.sources.store import MessageStore
from talkgrain.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Enter a query by its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_WINNERS = """
k AS (SELECT row_id, post_time, try_cast(nullif(regexp_extract(url, '(?i)/c/([0-9]+)/([0-9]+)', 1), '') AS BIGINT) AS share,
             try_cast(nullif(regexp_extract(url, '(?i)/c/([0-9]+)/([0-9]+)', 2), '') AS BIGINT) AS msg FROM messages),
r AS (SELECT *, row_number() OVER (PARTITION BY share, msg, CASE WHEN share IS NULL THEN row_id END
                                   ORDER BY post_time DESC NULLS LAST, row_id) AS rn FROM k)"""


@query(f"WITH {_WINNERS} SELECT row_id FROM r WHERE rn > 1")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deliveries.dropped(read_table(spark, sf_dir, "messages"), scratch(spark, "deliveries"))


@query(f"WITH {_WINNERS} SELECT share, msg, row_id, post_time FROM r WHERE rn = 1")
def p2_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = deliveries.kept(read_table(spark, sf_dir, "messages"), scratch(spark, "deliveries"))
    return rows.select("share", "msg", "row_id", "post_time")


# ---- stored messages, in SQL as operators.search.stored and functions.analyze.tokens give them

_UNESCAPED = "replace(replace(replace(replace(replace(replace(coalesce(content, ''), '&#x27;', ''''), '&#39;', ''''), '&quot;', '\"'), '&gt;', '>'), '&lt;', '<'), '&amp;', '&')"
_SHARE = "CASE WHEN chat_id >= 0 THEN chat_id WHEN chat_id < -1000000000000 THEN -chat_id - 1000000000000 ELSE -chat_id END"
_STORED = f"""
s0 AS (SELECT coalesce(try_cast(nullif(regexp_extract(url, '(?i)/c/([0-9]+)/([0-9]+)', 1), '') AS BIGINT), {_SHARE}) AS chat_id,
              try_cast(nullif(regexp_extract(url, '(?i)/c/([0-9]+)/([0-9]+)', 2), '') AS BIGINT) AS msg_id, row_id, post_time,
              coalesce(sender, '') AS sender, {_UNESCAPED} AS content FROM messages),
s AS (SELECT chat_id, msg_id, 'https://chat.example/c/' || chat_id || '/' || msg_id AS url, sender, content, post_time
      FROM (SELECT *, row_number() OVER (PARTITION BY chat_id, msg_id ORDER BY post_time DESC NULLS LAST, row_id) AS rn FROM s0 WHERE chat_id IS NOT NULL AND msg_id IS NOT NULL) WHERE rn = 1)"""
_RUNS = r"regexp_extract_all(regexp_replace(lower(content), '([\x{4e00}-\x{9fff}]+)', ' \1 ', 'g'), '[\p{L}\p{N}_]+')"
_TOKENS = rf"list_filter(flatten(list_transform({_RUNS}, lambda r: CASE WHEN regexp_matches(r, '^[\x{{4e00}}-\x{{9fff}}]') AND length(r) > 1 THEN list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) ELSE [r] END)), lambda t: length(t) >= 2 OR regexp_matches(t, '^[\x{{4e00}}-\x{{9fff}}]'))"
_INDEXED = f"{_STORED}, x AS (SELECT *, {_TOKENS} AS tokens FROM s)"
_CHATS = r"c AS (SELECT id AS chat_id, min(t) AS title FROM (SELECT id, regexp_replace(regexp_replace(name, '^[\s\x{00a0}\x{3000}]+', ''), '[\s\x{00a0}\x{3000}]+$', '') AS t FROM dialogs) WHERE length(t) > 0 GROUP BY id)"


def search_index(spark: SparkSession, sf_dir: str, p: Profile = PLAIN) -> SearchIndex:
    """The index of the messages of a folder, written by the first query of an application that needs it, as ingest would."""
    name = hashlib.md5(f"{spark.sparkContext.applicationId} {sf_dir} {p}".encode()).hexdigest()
    found = SearchIndex(spark, scratch(spark, f"search-{name}", unique=False), p)
    if not found.exists():
        found.write(searching.stored(read_table(spark, sf_dir, "messages")))
    return found


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_index(spark, sf_dir).read().drop("tokens", "month")


def hits(spark: SparkSession, sf_dir: str, asked: str, chats: list[int] | None = None) -> DataFrame:
    return search_index(spark, sf_dir).search(asked, chats)


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_list.titles(read_table(spark, sf_dir, "dialogs"))


def _has(*words: str) -> str:
    return "(" + " AND ".join(f"list_contains(tokens, '{w}')" for w in words) + ")"


#: Name, query text and the condition it stands for.
SEARCHES = {
    "search_term": ("invoices", _has("invoices")),
    "search_adjacent": ("loan rates", _has("loan", "rates")),
    "search_and": ("ferry AND visa", _has("ferry", "visa")),
    "search_or": ("invoices OR счета OR ferry", f"({_has('invoices')} OR {_has('счета')} OR {_has('ferry')})"),
    "search_not": ("ferry AND NOT tickets", f"{_has('ferry')} AND NOT {_has('tickets')}"),
    "search_only_not": ("NOT the", f"NOT {_has('the')}"),
    "search_group": ("NOT ferry AND (loan OR visa)", f"NOT {_has('ferry')} AND ({_has('loan')} OR {_has('visa')})"),
    "search_phrase": ('"night trains"', "contains(' ' || array_to_string(tokens, ' ') || ' ', ' night trains ')"),
    "search_cjk": ("贷款利率", _has("贷款", "款利", "利率")),
    "search_cjk_phrase": ('"贷款利率"', "contains(' ' || array_to_string(tokens, ' ') || ' ', ' 贷款 款利 利率 ')"),
    "search_cjk_single": ("贷", "contains(content, '贷')"),
    "search_wildcard": ("t*ets", "len(list_filter(tokens, lambda t: regexp_full_match(t, 't.*ets'))) > 0"),
    "search_single_wildcard": ("l?an", "len(list_filter(tokens, lambda t: regexp_full_match(t, 'l.an'))) > 0"),
    "search_prefix": ("ferr*", "len(list_filter(tokens, lambda t: starts_with(t, 'ferr'))) > 0"),
    "search_field_sender": ("sender:nadia AND tickets", rf"list_contains(regexp_extract_all(lower(sender), '[\p{{L}}\p{{N}}_]+'), 'nadia') AND {_has('tickets')}"),
    "search_field_chat": ("chat_id:1300000417 AND loan", f"chat_id = 1300000417 AND {_has('loan')}"),
    "search_time_range": ("post_time:[20240601 TO 20240930] AND loan", f"post_time >= TIMESTAMP '2024-06-01' AND post_time < TIMESTAMP '2024-10-01' AND {_has('loan')}"),
    "search_time_open": ("post_time:{20251001 TO} AND loan", f"post_time >= TIMESTAMP '2025-10-02' AND {_has('loan')}"),
    "search_period": ("post_time:202407 AND ferry", f"post_time >= TIMESTAMP '2024-07-01' AND post_time < TIMESTAMP '2024-08-01' AND {_has('ferry')}"),
    "search_slop": ('"tickets next"~3', "len(list_filter(range(1, len(tokens) + 1), lambda i: tokens[i] = 'next' AND len(list_filter(range(greatest(1, i - 4), i), lambda j: tokens[j] = 'tickets')) > 0)) > 0"),
    "search_boost": ("ferry^2 OR visa^0.5", f"({_has('ferry')} OR {_has('visa')})"),
    "search_every": ("*:* ANDNOT the", f"NOT {_has('the')}"),
    "search_require": ("loan REQUIRE rates", _has("loan", "rates")),
    "search_andmaybe": ("loan ANDMAYBE ferry", _has("loan")),
    "search_literal": ("'ferry'", _has("ferry")),
    "search_no_words": ("?! ...", "false"),
}


def _searcher(asked: str) -> Query:
    return lambda spark, sf_dir: hits(spark, sf_dir, asked).select("chat_id", "msg_id", "post_time")


for _name, (_text, _where) in SEARCHES.items():
    QUERIES[_name] = _searcher(_text)
    ORACLES[_name] = f"WITH {_INDEXED} SELECT chat_id, msg_id, post_time FROM x WHERE {_where}"

_HITS = f"WITH {_INDEXED}, h AS (SELECT * FROM x WHERE {_has('ferry')})"
_NEWEST = "ORDER BY post_time DESC NULLS LAST, chat_id, msg_id"


@query(f"{_HITS} SELECT chat_id, msg_id, post_time FROM h WHERE chat_id IN (1300000417, 1300021863)")
def search_in_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir, "ferry", [1300000417, 1300021863]).select("chat_id", "msg_id", "post_time")


@query(f"{_HITS} SELECT chat_id, msg_id, post_time FROM h {_NEWEST} LIMIT 10 OFFSET 10")
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searching.page(hits(spark, sf_dir, "ferry"), 2).select("chat_id", "msg_id", "post_time")


@query(f"{_HITS}, n AS (SELECT count(*) AS n FROM h) SELECT chat_id, msg_id, post_time FROM h {_NEWEST} LIMIT 10 OFFSET (SELECT greatest(0, (n - 1) // 10 * 10) FROM n)")
def search_page_beyond(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searching.page(hits(spark, sf_dir, "ferry"), 1_000_000).select("chat_id", "msg_id", "post_time")


@query(f"{_HITS} SELECT count(*) AS total_results, CAST(ceil(count(*) / 10) AS BIGINT) AS pages, count(*) > 0 AND false AS has_prev, count(*) > 10 AS has_next FROM h")
def search_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searching.totals(hits(spark, sf_dir, "ferry"))



def _escape_sql(s: str) -> str:
    return f"replace(replace(replace(replace(replace({s}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


_CUT = r"regexp_extract_all(regexp_replace(content, '([\x{4e00}-\x{9fff}])', chr(1) || '\1' || chr(1), 'g'), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+')"
_BOLD = f"replace(array_to_string(list_transform({_CUT}, lambda w: CASE WHEN lower(w) IN ('ferry', 'tickets') THEN '<b>' || {_escape_sql('w')} || '</b>' ELSE {_escape_sql('w')} END), ''), chr(1), '')"


@query(f"{_HITS} SELECT chat_id, msg_id, {_BOLD} AS highlighted FROM h WHERE {_has('tickets')}")
def search_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = "ferry tickets"
    return hits(spark, sf_dir, asked).select("chat_id", "msg_id", searching.highlight(F.col("content"), searching.query_words(asked)).alias("highlighted"))


@query(f"{_HITS}, {_CHATS} SELECT h.chat_id, msg_id, coalesce(title, '[unknown chat]') AS title FROM h LEFT JOIN c USING (chat_id)")
def search_with_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searching.with_titles(hits(spark, sf_dir, "ferry"), chats(spark, sf_dir)).select("chat_id", "msg_id", "title")


_PIECES = "regexp_extract_all(content, '(?is).{0,20}(?:tickets|ferry).{0,173}')"
_MARKED = _BOLD.replace("content", "p.t")


@query(f"""{_HITS}, f AS (SELECT chat_id, msg_id, list_sort(list_transform({_PIECES}, lambda t, i: {{'n': -len(regexp_extract_all(t, '(?i)(?:tickets|ferry)')), 'i': i, 't': t}}))[1:3] AS ps FROM h WHERE {_has('tickets')})
SELECT chat_id, msg_id, array_to_string(list_transform(ps, lambda p: {_MARKED}), ' … ') AS fragment FROM f""")
def search_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir, "ferry tickets").select("chat_id", "msg_id", searching.fragments(F.col("content"), ["ferry", "tickets"]).alias("fragment"))


def _any_of(pattern: str) -> str:
    return f"len(list_filter(tokens, lambda t: regexp_full_match(t, '{pattern}'))) > 0"


@query(f"WITH {_INDEXED} SELECT chat_id, msg_id, post_time FROM x WHERE {_any_of('arriv(e|es|ed|ing|al|als|er|ers)?')} AND {_any_of('ticket(s|ed|ing)?')}")
def stemmed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of one stem are one; the SQL lists them."""
    return search_index(spark, sf_dir, Profile(stop_words=True, stem=True)).search("arriving tickets").select("chat_id", "msg_id", "post_time")


_KEPT = "list_filter(tokens, lambda t: t NOT IN (" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "))"


@query(f"WITH {_INDEXED} SELECT chat_id, msg_id, post_time FROM x WHERE contains(' ' || array_to_string({_KEPT}, ' ') || ' ', ' need book ')")
def search_stop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase over what is left without stop-words, in the messages as in the query."""
    return search_index(spark, sf_dir, Profile(stop_words=True)).search('"need to book"').select("chat_id", "msg_id", "post_time")


@query(f"WITH {_INDEXED} SELECT chat_id, msg_id, content FROM x WHERE url = (SELECT min(url) FROM x)")
def search_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field url is compared whole."""
    url = stored(spark, sf_dir).agg(F.min("url")).first()[0]
    return hits(spark, sf_dir, f'url:"{url}"').select("chat_id", "msg_id", "content")


@query(f"WITH {_INDEXED} SELECT chat_id, msg_id, post_time FROM x WHERE {_has('next')} AND len(list_filter(tokens, lambda t: regexp_full_match(t, 'wee.s?'))) > 0")
def search_segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words are cut by a segmenter given by the caller, here one that leaves CJK runs whole; others are as ever."""
    p = Profile(segment=_whole)
    return searching.search(searching.indexed(stored(spark, sf_dir), p), "next AND (wee? OR wee?s)", p=p).select("chat_id", "msg_id", "post_time")


def _whole(run: str) -> list[str]:
    return [run]



def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First page of a search with highlights, titles and the total."""
    asked = "ferry OR loan OR visa"
    found = hits(spark, sf_dir, asked)
    first = searching.with_titles(searching.page(found), chats(spark, sf_dir)).crossJoin(searching.totals(found).select("total_results"))
    return first.select("chat_id", "msg_id", "title", "post_time", searching.highlight(F.col("content"), searching.query_words(asked)).alias("highlighted"), "total_results")


# ---- scalar functions

_PY_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STRIPPED = rf"regexp_replace(raw_text, '^{_PY_SPACE}+|{_PY_SPACE}+$', '', 'g')"
_TEXT = f"coalesce(replace({_escape_sql(_STRIPPED)}, chr(10), ' '), '')"
_NAME = rf"CASE WHEN sender IS NULL THEN '' ELSE regexp_replace(coalesce(sender.first_name, '') || ' ' || coalesce(sender.last_name, ''), '^{_PY_SPACE}+|{_PY_SPACE}+$', '', 'g') END"


@query(f"SELECT seq, {_TEXT} AS content FROM incoming")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "incoming").select("seq", text.extract_text(F.col("raw_text")).alias("content"))


@query("SELECT row_id, CASE WHEN length(content) < 20 THEN content ELSE substr(content, 1, 16) || '…' || right(content, 2) END AS brief FROM messages")
def brief_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "messages").select("row_id", text.brief(F.col("content")).alias("brief"))


@query(f"SELECT row_id, {_SHARE} AS share_id FROM messages")
def share_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "messages").select("row_id", ids.share_id(F.col("chat_id")).alias("share_id"))


@query(f"SELECT seq, 'https://chat.example/c/' || ({_SHARE}) || '/' || id AS url FROM edits")
def message_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "edits").select("seq", ids.message_url(ids.share_id(F.col("chat_id")), F.col("id")).alias("url"))


@query(f"SELECT seq, {_NAME} AS name FROM incoming")
def sender_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "incoming").select("seq", text.sender_name(F.col("sender")).alias("name"))


@query("SELECT row_id, CASE WHEN content LIKE '/%' OR content LIKE '@%' THEN CASE WHEN instr(content, ' ') > 0 THEN substr(content, instr(content, ' ') + 1) ELSE '' END ELSE content END AS query FROM messages")
def command_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "messages").select("row_id", text.strip_command(F.col("content")).alias("query"))


@query("SELECT seq, array_to_string(deleted_ids, ',') AS csv, deleted_ids AS ids FROM deletes")
def id_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "deletes").select("seq", text.ids_to_csv(F.col("deleted_ids")).alias("csv"))
    return rows.withColumn("ids", text.csv_to_ids(F.col("csv")))


@query(f"""WITH {_STORED}, {_CHATS} SELECT chat_id, msg_id, '<b>' || {_escape_sql("coalesce(title, '[unknown chat]')")} || '</b>' || CASE WHEN length(sender) > 0 THEN ' (<u>' || {_escape_sql('sender')} || '</u>)' ELSE '' END
 || ' [' || coalesce(strftime(post_time, '%Y-%m-%d %H:%M:%S'), '') || ']' || chr(10) || '<a href="' || url || '">' || {_escape_sql('content')} || '</a>' AS html FROM s LEFT JOIN c USING (chat_id)""")
def render_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = searching.with_titles(stored(spark, sf_dir), chats(spark, sf_dir))
    html = text.render_hit(F.col("title"), F.col("sender"), F.col("url"), text.escape(F.col("content")), F.col("post_time"))
    return rows.select("chat_id", "msg_id", html.alias("html"))


# ---- catalogue


@query(f"WITH {_STORED} SELECT chat_id, count(*) AS n FROM s GROUP BY chat_id")
def chat_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_list.counts(stored(spark, sf_dir))


@query(f"WITH {_STORED} SELECT DISTINCT chat_id FROM s")
def distinct_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_list.distinct_chats(stored(spark, sf_dir))


@query(f"WITH {_STORED} SELECT count(*) AS n FROM s")
def total_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).agg(F.count("*").alias("n"))


@query(f"WITH {_STORED} SELECT chat_id, msg_id, post_time, content FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY post_time DESC NULLS LAST, msg_id) AS rn FROM s) WHERE rn = 1")
def newest_per_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_list.newest(stored(spark, sf_dir))


@query(f"WITH {_CHATS} SELECT chat_id, title, title || ' (' || chat_id || ')' AS label FROM c WHERE contains(title, 'Markt')")
def list_chats_cs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_list.matching(chats(spark, sf_dir), "Markt")


@query(f"WITH {_CHATS} SELECT chat_id, title, title || ' (' || chat_id || ')' AS label FROM c WHERE contains(lower(title), 'helpdesk') ORDER BY chat_id LIMIT 50")
def find_chats_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_list.matching(chats(spark, sf_dir), "HelpDesk", case=False, most=50)


_BRIEF = "CASE WHEN length(content) < 20 THEN content ELSE substr(content, 1, 16) || '…' || right(content, 2) END"
_STATUS = f"""WITH {_STORED}, {_CHATS}, l AS (SELECT chat_id, content FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY post_time DESC NULLS LAST, msg_id) AS rn FROM s) WHERE rn = 1),
n AS (SELECT chat_id, count(*) AS n FROM s GROUP BY chat_id),
e AS (SELECT DISTINCT id AS chat_id FROM dialogs WHERE contains(lower(name), 'helpdesk')),
t AS (SELECT 0 AS section, NULL::BIGINT AS chat_id, (SELECT count(*) FROM s) || ' messages in ' || (SELECT count(*) FROM n) || ' chats' AS line
      UNION ALL SELECT 1, NULL, count(*) || ' chats excluded' FROM e
      UNION ALL SELECT 1, chat_id, 'excluded: ' || coalesce(title, '?') || ' (' || chat_id || ')' FROM e LEFT JOIN c USING (chat_id)
      UNION ALL SELECT 2, chat_id, coalesce(title, '?') || ' (' || chat_id || '): ' || n || ' messages, newest: ' || {_BRIEF} FROM n JOIN l USING (chat_id) LEFT JOIN c USING (chat_id)),
o AS (SELECT *, row_number() OVER w AS place, sum(length(line) + 1) OVER w AS upto FROM t WINDOW w AS (ORDER BY section, chat_id NULLS FIRST)),
r AS (SELECT * FROM o WHERE upto <= 3960),
z AS (SELECT place, chat_id, line FROM r UNION ALL SELECT (SELECT max(place) FROM r) + 1, NULL, 'and ' || ((SELECT count(*) FROM n) - (SELECT count(*) FROM r WHERE section = 2)) || ' more chats' WHERE (SELECT count(*) FROM n) > (SELECT count(*) FROM r WHERE section = 2))"""


def _helpdesks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "dialogs").where(F.lower("name").contains("helpdesk")).select(F.col("id").alias("chat_id"))


@query(f"{_STATUS} SELECT place, chat_id, line FROM z")
def status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_list.status(stored(spark, sf_dir), chats(spark, sf_dir), excluded=_helpdesks(spark, sf_dir))


@query(f"{_STATUS} SELECT string_agg(line, chr(10) ORDER BY place) AS text FROM z")
def status_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_list.joined(status_report(spark, sf_dir))


@query(f"WITH {_CHATS}, e AS (SELECT DISTINCT id AS chat_id FROM dialogs WHERE contains(lower(name), 'helpdesk')) SELECT chat_id, title, (SELECT count(*) FROM e) AS excluded FROM e LEFT JOIN c USING (chat_id)")
def excluded_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excluded chats with their titles and how many they are."""
    gone = _helpdesks(spark, sf_dir).distinct()
    return gone.join(chats(spark, sf_dir), "chat_id", "left").crossJoin(gone.agg(F.count("*").alias("excluded")))


@query(f"WITH {_STORED}, {_CHATS} SELECT chat_id, title, title || ' (' || chat_id || ')' AS label FROM c WHERE chat_id IN (SELECT chat_id FROM s) AND contains(title, 'a')")
def watched_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_list.watched(chats(spark, sf_dir), stored(spark, sf_dir), "a")


@query(f"WITH {_STORED}, {_CHATS} SELECT chat_id, chat_id IN (SELECT chat_id FROM s) AS has_rows FROM c")
def chats_with_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_list.with_rows(chats(spark, sf_dir), stored(spark, sf_dir))


@query(f"WITH {_CHATS}, n AS (SELECT id, name, regexp_replace(regexp_replace(name, '^[\\s\\x{{00a0}}\\x{{3000}}]+', ''), '[\\s\\x{{00a0}}\\x{{3000}}]+$', '') AS t FROM dialogs UNION ALL SELECT id, CAST(-id - 1000000000000 AS VARCHAR), CAST(-id - 1000000000000 AS VARCHAR) FROM dialogs) "
       "SELECT id, name, CASE WHEN regexp_matches(t, '^-?[0-9]+$') THEN -try_cast(t AS BIGINT) - 1000000000000 ELSE (SELECT min(chat_id) FROM c WHERE title = t) END AS chat_id FROM n")
def entity_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share ids of names and of marked ids as typed."""
    rows = read_table(spark, sf_dir, "dialogs").select("id", "name")
    marked = rows.select("id", (-F.col("id") - ids.CHANNEL_OFFSET).cast("string").alias("name"))
    return chat_list.resolved(rows.unionByName(marked), chats(spark, sf_dir)).select("id", "name", "chat_id")


@query(f"WITH {_CHATS} SELECT chat_id, '<a href=\"https://chat.example/c/' || chat_id || '/99999999\">' || {_escape_sql('title')} || '</a>' AS html, 'select_chat=' || chat_id AS payload FROM c")
def chat_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats(spark, sf_dir).select("chat_id", text.chat_link(F.col("title"), F.col("chat_id")).alias("html"), F.concat(F.lit("select_chat="), F.col("chat_id").cast("string")).alias("payload"))


@query("SELECT row_id, CASE row_id % 3 WHEN 0 THEN 'search_page' WHEN 1 THEN 'select_chat' END AS key, CASE WHEN row_id % 3 < 2 THEN chat_id END AS value FROM messages")
def button_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of pressed buttons, known, unknown and malformed."""
    rows = read_table(spark, sf_dir, "messages")
    made = F.when(F.col("row_id") % 3 == 0, F.concat(F.lit("search_page="), F.col("chat_id").cast("string"))).when(F.col("row_id") % 3 == 1, F.concat(F.lit("select_chat="), F.col("chat_id").cast("string"))).otherwise(F.concat(F.lit("other="), F.col("sender")))
    return rows.select("row_id", text.payload(made).alias("x")).select("row_id", "x.key", "x.value")


@query("SELECT row_id, CASE WHEN row_id % 2 = 0 THEN regexp_extract(url, '^[^/]*//[^/]*') END AS host, CASE WHEN row_id % 2 = 0 THEN CAST(row_id % 65536 AS INT) END AS port FROM messages WHERE url IS NOT NULL AND url NOT LIKE '%:%:%'")
def host_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "messages").where("url IS NOT NULL AND url NOT LIKE '%:%:%'")
    made = F.concat(F.regexp_extract("url", "^[^/]*//[^/]*", 0), F.when(F.col("row_id") % 2 == 0, F.concat(F.lit(":"), (F.col("row_id") % 65536).cast("string"))).otherwise(F.lit("")))
    return rows.select("row_id", text.host_port(made).alias("x")).select("row_id", "x.host", "x.port")


@query(rf"SELECT id, regexp_replace(coalesce(name, ''), '^{_PY_SPACE}+|{_PY_SPACE}+$', '', 'g') AS keyword FROM dialogs")
def keyword_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is searched for when each name is typed behind a command."""
    typed = F.concat(F.lit("/find_chat_id "), F.coalesce("name", F.lit("")))
    return read_table(spark, sf_dir, "dialogs").select("id", text.keyword_after(typed, "/find_chat_id").alias("keyword"))


@query("SELECT row_id, timezone('Europe/Berlin', timezone('UTC', post_time)) AS shown FROM messages")
def local_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "messages").select("row_id", text.local_time(F.col("post_time"), "Europe/Berlin").alias("shown"))


@query(f"""SELECT row_id, (row_id % 7 IN (1, 3)) OR coalesce(({_SHARE}) IN (1300000417, 1300021863), true) AS private_ok,
       row_id % 2 = 1 OR row_id % 5 = 0 OR coalesce(contains(content, '@support_bot'), false) AS group_ok, row_id % 7 <> 2 AS not_own FROM messages""")
def message_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which messages pass the privacy gate, the group gate and that of own messages."""
    sender, group, mentioned = F.col("row_id") % 7, F.col("row_id") % 2 == 0, F.col("row_id") % 5 == 0
    return read_table(spark, sf_dir, "messages").select(
        "row_id", gates.private(sender, F.col("chat_id"), [1, 3, 1300000417, 1300021863]).alias("private_ok"),
        gates.addressed(F.col("content"), group, mentioned, "support_bot").alias("group_ok"), gates.foreign(sender, 2).alias("not_own"))


def random_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_list.random_message(stored(spark, sf_dir), 7)


QUERIES["random_message"] = random_message

# ---- changes

_NEW = f"SELECT seq, {_SHARE} AS chat_id, id AS msg_id, {_NAME} AS sender, {_TEXT} AS content, sent_at AS post_time, arrived_at AS happened FROM (SELECT * REPLACE (CAST(chat_id AS BIGINT) AS chat_id) FROM incoming) WHERE chat_id IS NOT NULL AND chat_id <> 0 AND length({_TEXT}) > 0"
_LOG = f"""
g AS (SELECT 'new' AS op, 0 AS rank, * FROM ({_NEW})
      UNION ALL SELECT 'edit', 1, seq, {_SHARE}, id, NULL, {_TEXT}, NULL, edited_at FROM edits WHERE chat_id <> 0 AND length({_TEXT}) > 0
      UNION ALL SELECT DISTINCT 'delete', 2, seq, {_SHARE}, unnest(deleted_ids), NULL, NULL, NULL::TIMESTAMP, deleted_at FROM (SELECT * REPLACE (CAST(chat_id AS BIGINT) AS chat_id) FROM deletes) WHERE chat_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY chat_id, msg_id ORDER BY happened, rank, seq) AS k FROM g),
d AS (SELECT chat_id, msg_id, max(k) AS gone FROM o WHERE op = 'delete' GROUP BY ALL),
v AS (SELECT o.* FROM o LEFT JOIN d USING (chat_id, msg_id) WHERE op <> 'delete' AND k > coalesce(gone, 0)),
f AS (SELECT chat_id, msg_id, 'https://chat.example/c/' || chat_id || '/' || msg_id AS url, arg_max(sender, k) FILTER (op = 'new') AS sender, arg_max(content, k) AS content, arg_max(post_time, k) FILTER (op = 'new') AS post_time
      FROM v GROUP BY chat_id, msg_id HAVING count(*) FILTER (op = 'new') > 0)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.merged(*(read_table(spark, sf_dir, t) for t in ("incoming", "edits", "deletes")))


@query(f"WITH {_LOG} SELECT * FROM f")
def apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.fold(_log(spark, sf_dir))


@query(f"WITH {_STORED} SELECT s.chat_id, s.msg_id FROM s WHERE (chat_id, msg_id) NOT IN (SELECT ({_SHARE}), m FROM (SELECT CAST(chat_id AS BIGINT) AS chat_id, unnest(deleted_ids) AS m FROM deletes WHERE chat_id IS NOT NULL))")
def apply_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = changes.from_deletes(read_table(spark, sf_dir, "deletes")).select("chat_id", "msg_id").distinct()
    return stored(spark, sf_dir).join(gone, ["chat_id", "msg_id"], "left_anti").select("chat_id", "msg_id")


@query(f"WITH {_STORED} SELECT chat_id, msg_id FROM s WHERE chat_id NOT IN (SELECT id FROM dialogs WHERE contains(lower(name), 'helpdesk'))")
def clear_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = read_table(spark, sf_dir, "dialogs").where(F.lower("name").contains("helpdesk")).select(F.col("id").alias("chat_id"))
    return changes.without(stored(spark, sf_dir), gone).select("chat_id", "msg_id")


@query(f"WITH {_STORED} SELECT chat_id, msg_id, url, sender, content, post_time FROM s")
def dedupe_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searching.stored(read_table(spark, sf_dir, "messages"))


@query(f"SELECT chat_id, msg_id, sender, content, post_time FROM (SELECT *, row_number() OVER (PARTITION BY chat_id, msg_id ORDER BY seq DESC) AS rn FROM ({_NEW}) WHERE msg_id > 10 AND msg_id < 500) WHERE rn = 1")
def history_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.history(read_table(spark, sf_dir, "incoming"), None, 10, 500).select("chat_id", "msg_id", "sender", "content", "post_time")


@query(f"SELECT seq, chat_id, msg_id FROM ({_NEW}) WHERE chat_id IN (SELECT id FROM dialogs)")
def monitored_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    watched = read_table(spark, sf_dir, "dialogs").select(F.col("id").alias("chat_id"))
    return changes.monitored(changes.from_messages(read_table(spark, sf_dir, "incoming")), watched).select("seq", "chat_id", "msg_id")


@query(f"SELECT seq, chat_id, msg_id FROM ({_NEW}) WHERE chat_id NOT IN (SELECT id FROM dialogs)")
def excluded_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = read_table(spark, sf_dir, "dialogs").select(F.col("id").alias("chat_id"))
    return changes.monitored(changes.from_messages(read_table(spark, sf_dir, "incoming")), named, exclude=True).select("seq", "chat_id", "msg_id")


# ---- store, streams and commands

_CHANGES = f"""
g AS (SELECT 'new' AS op, seq, chat_id, msg_id, sender, content, post_time FROM ({_NEW})
      UNION ALL SELECT 'edit', 1000000 + seq, {_SHARE}, id, NULL, {_TEXT}, NULL FROM edits WHERE chat_id <> 0 AND length({_TEXT}) > 0
      UNION ALL SELECT DISTINCT 'delete', 2000000 + seq, {_SHARE}, unnest(deleted_ids), NULL, NULL, NULL::TIMESTAMP FROM (SELECT * REPLACE (CAST(chat_id AS BIGINT) AS chat_id) FROM deletes) WHERE chat_id IS NOT NULL),
o AS (SELECT *, seq AS k FROM g),
d AS (SELECT chat_id, msg_id, max(k) AS gone FROM o WHERE op = 'delete' GROUP BY ALL),
v AS (SELECT o.* FROM o LEFT JOIN d USING (chat_id, msg_id) WHERE op <> 'delete' AND k > coalesce(gone, 0)),
f AS (SELECT chat_id, msg_id, 'https://chat.example/c/' || chat_id || '/' || msg_id AS url, arg_max(sender, k) FILTER (op = 'new') AS sender, arg_max(content, k) AS content, arg_max(post_time, k) FILTER (op = 'new') AS post_time
      FROM v GROUP BY chat_id, msg_id HAVING count(*) FILTER (op = 'new') > 0)"""


def _feeds(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The three feeds as changes, one behind the other."""
    made = (changes.from_messages(read_table(spark, sf_dir, "incoming")), changes.from_edits(read_table(spark, sf_dir, "edits")), changes.from_deletes(read_table(spark, sf_dir, "deletes")))
    return [df.withColumn("seq", F.col("seq") + 1_000_000 * k) for k, df in enumerate(made)]


def message_store(spark: SparkSession, sf_dir: str) -> MessageStore:
    """A new store that took each feed as a bulk of its own."""
    store = MessageStore(spark, scratch(spark, "store"), from_scratch=True)
    for df in _feeds(spark, sf_dir):
        store.append(df)
    return store


@query(f"WITH {_CHANGES} SELECT * FROM f")
def store_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening a store, bulk appends and the fold of its log."""
    return message_store(spark, sf_dir).live()


@query(f"WITH {_CHANGES} SELECT * FROM f")
def store_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = message_store(spark, sf_dir)
    store.compact()
    return store.live()


@query(f"WITH {_CHANGES} SELECT * FROM f WHERE (chat_id, msg_id) = (SELECT (chat_id, msg_id) FROM f ORDER BY chat_id, msg_id LIMIT 1)")
def store_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = message_store(spark, sf_dir)
    first = store.live().orderBy("chat_id", "msg_id").select("url").first()  # an url that is there
    return store.get(first["url"])


@query(f"WITH {_CHANGES} SELECT chat_id, msg_id, content FROM f WHERE chat_id = 1300000417 AND sender = (SELECT max(sender) FROM f WHERE chat_id = 1300000417)")
def store_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by exact values of named fields."""
    store = message_store(spark, sf_dir)
    who = store.find(chat_id=1300000417).agg(F.max("sender")).first()[0]
    return store.find(chat_id=1300000417, sender=who).select("chat_id", "msg_id", "content")


@query(f"WITH {_CHANGES} SELECT chat_id, msg_id FROM f WHERE chat_id NOT IN (SELECT id FROM dialogs WHERE contains(lower(name), 'helpdesk'))")
def store_clear_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = message_store(spark, sf_dir)
    store.clear_chats(_helpdesks(spark, sf_dir))
    return store.live().select("chat_id", "msg_id")


@query("SELECT 0::BIGINT AS n")
def store_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = message_store(spark, sf_dir)
    store.clear()
    return store.live().agg(F.count("*").alias("n"))


@query(f"SELECT chat_id, msg_id, sender, content, post_time FROM (SELECT *, row_number() OVER (PARTITION BY chat_id, msg_id ORDER BY seq DESC) AS rn FROM ({_NEW}) WHERE msg_id > 1 AND msg_id < 1073741824 AND chat_id = 1300000417) WHERE rn = 1")
def store_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chat's history taken into an empty store."""
    store = MessageStore(spark, scratch(spark, "store"), from_scratch=True)
    store.backfill(read_table(spark, sf_dir, "incoming"), 1300000417)
    return store.live().select("chat_id", "msg_id", "sender", "content", "post_time")


@query(f"WITH {_CHANGES} SELECT * FROM f WHERE chat_id IN (SELECT id FROM dialogs)")
def stream_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feeds as a stream of files, in several batches, into a store; chats watched are read anew for each."""
    at = scratch(spark, "stream")
    for df in _feeds(spark, sf_dir):
        df.select(*[df[f.name].cast(f.dataType) for f in CHANGES.fields]).repartition(2).write.mode("append").parquet(f"{at}/in")
    store = MessageStore(spark, f"{at}/store", from_scratch=True)
    watched = lambda: read_table(spark, sf_dir, "dialogs").select(F.col("id").alias("chat_id"))
    live.follow(live.read_changes(spark, f"{at}/in", 2), store, f"{at}/checkpoint", watched).awaitTermination()
    return store.live()


@query(f"SELECT chat_id, CAST(date_trunc('day', post_time) AS TIMESTAMP) AS day, count(*) AS n FROM ({_NEW}) WHERE post_time IS NOT NULL GROUP BY ALL")
def arrivals_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = live.all_arrivals(changes.from_messages(read_table(spark, sf_dir, "incoming")))
    return rows.select("chat_id", F.col("window.start").cast("timestamp_ntz").alias("day"), "n")


@query(f"WITH m AS (SELECT DISTINCT chat_id, msg_id FROM ({_NEW})), p AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY msg_id DESC) AS done, min(msg_id) OVER (PARTITION BY chat_id) AS least FROM m) SELECT chat_id, done, msg_id, msg_id - least AS remaining FROM p WHERE done % 50 = 0")
def download_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of a download: every so-many-th row of a chat and what is left."""
    return changes.progress(changes.from_messages(read_table(spark, sf_dir, "incoming")), 50)


@query(f"SELECT chat_id, count(*) AS rows FROM ({_NEW}) GROUP BY chat_id")
def download_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.downloaded(changes.from_messages(read_table(spark, sf_dir, "incoming")))


@query(f"WITH {_STORED} SELECT chat_id FROM s UNION SELECT {_SHARE} FROM (SELECT CAST(chat_id AS BIGINT) AS chat_id FROM incoming WHERE chat_id IS NOT NULL)")
def watched_after_download(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats watched after a start (those with messages) and a download of others."""
    named = read_table(spark, sf_dir, "incoming").where("chat_id IS NOT NULL").select(ids.share_id(F.col("chat_id").cast("bigint")).alias("chat_id"))
    return chat_list.distinct_chats(stored(spark, sf_dir)).unionByName(named).distinct()


def _desk(spark: SparkSession, sf_dir: str) -> Frontdesk:
    store = MessageStore(spark, scratch(spark, "store"), from_scratch=True)
    store.append(changes.from_messages(read_table(spark, sf_dir, "incoming")))
    return Frontdesk(store, chats(spark, sf_dir), config.Frontend("f", "b", admin=1, no_redis=True), feeds=lambda name: read_table(spark, sf_dir, name))


_DESK = f"""b AS (SELECT chat_id, msg_id, post_time, {_UNESCAPED} AS content FROM (SELECT *, row_number() OVER (PARTITION BY chat_id, msg_id ORDER BY seq DESC) AS rn FROM ({_NEW})) WHERE rn = 1),
y AS (SELECT *, {_TOKENS} AS tokens FROM b)"""


@query(f"WITH {_DESK} SELECT chat_id, msg_id FROM y WHERE {_has('the')} {_NEWEST} LIMIT 10 OFFSET 10")
def desk_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search and a press of the button to its second page, by the query that was kept."""
    desk = _desk(spark, sf_dir)
    desk.handle("the", sender=5, chat=7)
    return desk.press("search_page=2", 7).rows.select("chat_id", "msg_id")


@query(f"WITH {_DESK} SELECT chat_id, msg_id FROM y WHERE {_has('the')} AND chat_id = 1300000417 {_NEWEST} LIMIT 10")
def desk_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chat selected by a button; a reply to that message searches in it alone."""
    desk = _desk(spark, sf_dir)
    desk.press("select_chat=1300000417", 9)
    return desk.handle("the", sender=5, chat=7, replied=9).rows.select("chat_id", "msg_id")


@query(f"WITH {_CHATS} SELECT chat_id, title FROM c WHERE contains(lower(title), 'markt') ORDER BY chat_id LIMIT 50")
def desk_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """/refresh_chat_names and /find_chat_id of the admin."""
    desk = _desk(spark, sf_dir)
    desk.handle("/refresh_chat_names", sender=1)
    return desk.handle("/find_chat_id MARKT", sender=1).rows.select("chat_id", "title")


@query(f"SELECT 1300000417::BIGINT AS chat_id, count(*) AS rows FROM ({_NEW}) WHERE chat_id = 1300000417 AND msg_id > 5 AND msg_id < 1073741824")
def desk_download(spark: SparkSession, sf_dir: str) -> DataFrame:
    """/download_chat of a chat with a lower bound: the rows that came."""
    desk = _desk(spark, sf_dir)
    desk.store.clear()
    return desk.handle("/download_chat --min 5 1300000417", sender=1).rows
