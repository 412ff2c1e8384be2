"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What str.strip removes in Python, as a class of a regular expression.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends (trim removes spaces only)."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def escape(c: Column) -> Column:
    """HTML escapes, the ampersand first."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    for raw, safe in (("'", "&#x27;"), ("'", "&#39;"), ('"', "&quot;"), (">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def extract_text(raw: Column) -> Column:
    """Text of a message as stored: stripped, escaped, on one line; null and blank become empty."""
    return F.coalesce(F.replace(escape(strip(raw)), F.lit("\n"), F.lit(" ")), F.lit(""))


def brief(c: Column, n: int = 20) -> Column:
    """The whole text if shorter than n, else its head, an ellipsis and its last two characters."""
    return F.when(F.length(c) < n, c).otherwise(F.concat(F.substring(c, 1, n - 4), F.lit("…"), F.right(c, F.lit(2))))


def after_first_word(c: Column) -> Column:
    """What follows the first space; empty if there is none."""
    at = F.instr(c, " ")
    return F.when(at > 0, F.substr(c, at + 1)).when(at == 0, F.lit(""))


def strip_command(c: Column) -> Column:
    """A query without its leading command or mention."""
    return F.when(c.startswith("/") | c.startswith("@"), after_first_word(c)).otherwise(c)


def full_name(first: Column, last: Column) -> Column:
    return strip(F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit(""))))


def sender_name(sender: Column) -> Column:
    """Name of a user struct (first_name, last_name); empty where there is no user."""
    return F.when(sender.isNull(), F.lit("")).otherwise(full_name(sender["first_name"], sender["last_name"]))


def chat_label(title: Column, chat_id: Column) -> Column:
    return F.concat(title, F.lit(" ("), chat_id.cast("string"), F.lit(")"))


def chat_link(title: Column, chat_id: Column, host: str = "chat.example") -> Column:
    return F.concat(F.lit(f'<a href="https://{host}/c/'), chat_id.cast("string"), F.lit('/99999999">'), escape(title), F.lit("</a>"))


def render_hit(title: Column, sender: Column, url: Column, highlighted: Column, time: Column) -> Column:
    """Two lines of HTML: title, sender if there is one, time; the linked text."""
    head = F.concat(F.lit("<b>"), escape(title), F.lit("</b>"), F.when(F.length(sender) > 0, F.concat(F.lit(" (<u>"), escape(sender), F.lit("</u>)"))).otherwise(F.lit("")))
    return F.concat(head, F.lit(" ["), F.coalesce(F.date_format(time, "yyyy-MM-dd HH:mm:ss"), F.lit("")), F.lit("]\n"), F.lit('<a href="'), url, F.lit('">'), highlighted, F.lit("</a>"))


def ids_to_csv(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")


def csv_to_ids(csv: Column) -> Column:
    return F.when(F.length(csv) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.split(csv, ","), lambda x: x.try_cast("bigint")))


def keyword_after(c: Column, command: str) -> Column:
    """What follows a command and one more character, stripped; empty where there is no more."""
    return strip(F.substr(c, F.lit(len(command) + 2)))


def payload(c: Column) -> Column:
    """Key and value of a button `key=number`; null where it is none."""
    key, value = F.split_part(c, F.lit("="), F.lit(1)), F.split_part(c, F.lit("="), F.lit(2)).try_cast("bigint")
    return F.when(key.isin("search_page", "select_chat") & value.isNotNull(), F.struct(key.alias("key"), value.alias("value")))


def host_port(c: Column) -> Column:
    """host and port of `host:port`; null where the port is missing or no number."""
    parts = F.regexp_extract(c, r"^(.*):(\d+)$", 1), F.regexp_extract(c, r"^(.*):(\d+)$", 2).try_cast("int")
    return F.when(parts[1].isNotNull(), F.struct(parts[0].alias("host"), parts[1].alias("port")))


def local_time(c: Column, zone: str) -> Column:
    """A time without zone, as kept (UTC), on the clock of a display zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), c)
