"""Commands of users and the admin over a store: search with pages, chats, random, status, backfill, clear."""

from __future__ import annotations

import argparse
import shlex
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrain.config import Backend, Frontend
from talkgrain.functions.ids import share_number
from talkgrain.functions.text import chat_label, chat_link, local_time, render_hit, unescape
from talkgrain.operators import chats as chat_list
from talkgrain.operators import search as searching
from talkgrain.operators.changes import progress
from talkgrain.sources.store import HistoryExists, MessageStore
from talkgrain.state import State

CHATS_SHOWN = 50
#: Rows between two reports of a download.
PROGRESS = 500


class CommandError(ValueError):
    """A command can't be read."""


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise CommandError(message)


def arguments(text: str) -> argparse.Namespace:
    """--min, --max and chats of a command, quoted as in a shell."""
    p = _Parser(add_help=False)
    p.add_argument("chats", nargs="*")
    p.add_argument("--min", type=int)
    p.add_argument("--max", type=int)
    try:
        return p.parse_args(shlex.split(text))
    except ValueError as e:
        raise CommandError(str(e)) from None


def button(payload: str) -> tuple[str, int]:
    """(kind, value) of a pressed button: search_page=n or select_chat=id."""
    key, _, value = payload.partition("=")
    if key not in ("search_page", "select_chat") or not value.lstrip("-").isdigit():
        raise CommandError(f"unknown button {payload!r}")
    return key, int(value)


def allowed(f: Frontend, sender: int | None, chat: int | None) -> bool:
    """In private mode only listed senders and chats are answered; an unknown chat is not (`operators.gates` has it for rows)."""
    if not f.private_mode:
        return True
    return sender in f.private_whitelist or (chat is not None and share_number(chat) in f.private_whitelist)


def addressed(text: str, is_group: bool, mentioned: bool, username: str) -> bool:
    return not is_group or mentioned or f"@{username}" in text


@dataclass
class Reply:
    text: str
    rows: DataFrame | None = None
    seconds: float = 0.0
    buttons: dict[str, str] = field(default_factory=dict)


class Frontdesk:
    """Answers commands. The transport that carries them is not part of this library.

    backend: which chats are watched. Those with messages are at the start; with monitor_all all are but the excluded.
    feeds: where /download_chat and /refresh_chat_names read: raw messages and dialogs.
    """

    def __init__(self, store: MessageStore, chats: DataFrame, frontend: Frontend, state: State | None = None, backend: Backend | None = None,
                 feeds: Callable[[str], DataFrame] | None = None, username: str = "", log: Callable[[str], None] | None = None) -> None:
        self.store, self.chats, self.frontend, self.state = store, chats, frontend, state or State()
        self.backend, self.feeds, self.username, self.log = backend or Backend(frontend.backend), feeds, username, log or (lambda _: None)
        self.monitored = store.log().where("op = 'new'").select("chat_id").distinct()

    @property
    def excluded(self) -> DataFrame:
        return self.store.spark.createDataFrame([(share_number(i),) for i in self.backend.excluded_chats], "chat_id long")

    def taken(self) -> tuple[DataFrame, bool]:
        """Chats for `streaming.live.follow`, and whether these are left out in place of taken."""
        return (self.excluded, True) if self.backend.monitor_all else (self.monitored.join(self.excluded, "chat_id", "left_anti"), False)

    def handle(self, text: str, sender: int | None = None, chat: int | None = None, me: int | None = None, replied: int | None = None, group: bool = False, mentioned: bool = False) -> Reply | None:
        """The reply to a message, None where there is none: own messages, refused senders, others' talk in groups, blanks and /start."""
        text = text.strip()
        if (me is not None and sender == me) or not allowed(self.frontend, sender, chat) or not addressed(text, group, mentioned, self.username):
            return None
        word, _, rest = text.partition(" ")
        word = word.split("@")[0] if word.startswith("/") else word
        if not text or word == "/start":
            return None
        if sender == self.frontend.admin and (found := self._admin(word, rest.strip())):
            return found
        if word == "/random":
            return self._random()
        if word == "/chats":
            rows = chat_list.matching(self.chats.join(self.monitored, "chat_id", "left_semi"), rest)
            return Reply("Chats", rows.orderBy("chat_id"))
        if word.startswith("/") and word != "/search":
            return Reply(f"Unknown command {word}")
        query = rest if word == "/search" or text.startswith("@") else text
        return self.search(query, chat or 0, chats=self._selected(replied))

    def search(self, query: str, key: int = 0, number: int = 1, chats: list[int] | None = None) -> Reply | None:
        if not query.strip():
            return None
        began = time.time()
        live = self.store.live()
        live = live.withColumn("content", unescape(F.col("content")))  # stored escaped; hits are escaped anew
        hits = searching.search(searching.indexed(live), query, chats).cache()  # counted and shown
        total = hits.count()
        if not total and chat_list.is_empty(live):
            return Reply("The index is empty; add a chat first")
        length = self.frontend.page_len
        pages = -(-total // length)
        at = min(max(number, 1), max(pages, 1))
        rows = searching.with_titles(hits.orderBy(*searching.newest_first()).offset((at - 1) * length).limit(length), self.chats)
        words = searching.query_words(query)
        shown = rows.withColumn("html", render_hit(F.col("title"), F.col("sender"), F.col("url"), searching.fragments(F.col("content"), words), local_time(F.col("post_time"), self.frontend.zone)))
        page = shown.orderBy(*searching.newest_first()).collect()  # a page
        hits.unpersist()
        self.state.set(f"query:{key}", query)
        self.state.set(f"chats:{key}", ",".join(map(str, chats or ())))
        buttons = {f"search_page={at - 1}": "prev"} if at > 1 else {}
        if at < pages:
            buttons[f"search_page={at + 1}"] = "next"
        return Reply(f"{total} results, page {at} of {pages}", self.store.spark.createDataFrame(page, shown.schema), time.time() - began, buttons)

    def press(self, payload: str, key: int = 0) -> Reply | None:
        kind, value = button(payload)
        if kind == "select_chat":
            self.state.set(f"selected:{key}", value)
            return Reply(f"Selected {value}")
        query = self.state.get(f"query:{key}")
        ids = self.state.get(f"chats:{key}")
        return None if query is None else self.search(query, key, value, [int(x) for x in ids.split(",")] if ids else None)

    def _selected(self, replied: int | None) -> list[int] | None:
        got = None if replied is None else self.state.get(f"selected:{replied}")
        return None if got is None else [int(got)]

    def _random(self) -> Reply:
        row = searching.with_titles(chat_list.random_message(self.store.live()), self.chats)
        return Reply("The index is empty") if row.isEmpty() else Reply("Random message", row)

    def _admin(self, word: str, rest: str) -> Reply | None:
        ids = lambda names: [chat_list.resolve(self.chats, n) for n in names]
        spark = self.store.spark
        if word == "/stat":
            return Reply("Status", chat_list.status(self.store.live(), self.chats, excluded=self.excluded if self.backend.excluded_chats else None))
        if word == "/find_chat_id":
            rows = chat_list.matching(self.chats, rest, case=False, most=CHATS_SHOWN)
            return Reply("Found", rows.withColumn("html", chat_link(F.col("title"), F.col("chat_id"))))
        if word == "/download_chat":
            return Reply("Nothing to download from") if self.feeds is None else self.download(self.feeds("incoming"), rest)
        if word == "/refresh_chat_names":
            if self.feeds is None:
                return Reply("No chat names to read")
            self.refresh(self.feeds("dialogs"))
            return Reply("Chat names are up to date")
        if word == "/monitor_chat":
            new = spark.createDataFrame([(i,) for i in ids(arguments(rest).chats)], "chat_id long")
            self.monitored = self.monitored.unionByName(new).distinct()
            return Reply("Monitored", new)
        if word == "/clear":
            names = arguments(rest).chats
            if not names:
                return Reply("Usage: /clear all | CHAT...")
            if names == ["all"]:
                self.store.clear()
                self.monitored = self.monitored.limit(0)
                return Reply("Cleared")
            gone = spark.createDataFrame([(i,) for i in ids(names)], "chat_id long")
            self.store.clear_chats(gone)
            self.monitored = self.monitored.join(gone, "chat_id", "left_anti")
            return Reply("Cleared", gone)
        return None

    def download(self, incoming: DataFrame, text: str) -> Reply:
        """/download_chat: history of chats from a feed, guarded against a second whole backfill; rows: chat_id and how many rows came."""
        a = arguments(text)
        if not a.chats:
            return Reply("Usage: /download_chat [--min N] [--max N] CHAT...")
        spark, done = self.store.spark, []
        for name in a.chats:
            chat = chat_list.resolve(self.chats, name)
            try:
                rows = self.store.backfill(incoming, chat, a.min, a.max)
            except HistoryExists as e:
                return Reply(str(e))
            for r in progress(rows, PROGRESS).orderBy("done").collect():  # one row in PROGRESS of a chat
                self.log(f"{chat}: {r['done']} messages, about {r['remaining']} left")
            done.append((chat, rows.count()))
        new = spark.createDataFrame(done, "chat_id long, rows long")
        self.monitored = self.monitored.unionByName(new.select("chat_id")).distinct()
        return Reply(f"Downloaded {sum(n for _, n in done)} messages", new)

    def refresh(self, dialogs: DataFrame) -> None:
        """/refresh_chat_names: take the titles anew."""
        self.chats = chat_list.titles(dialogs)


def labels(chats: DataFrame) -> DataFrame:
    """chat_id, label, payload of the buttons by which a chat is selected."""
    return chats.select("chat_id", chat_label(F.col("title"), F.col("chat_id")).alias("label"), F.concat(F.lit("select_chat="), F.col("chat_id").cast("string")).alias("payload"))
