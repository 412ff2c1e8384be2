"""Command line: open the stores of a configuration, clear them on request, and answer lines from standard input."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from talkgrain import config
from talkgrain.commands import CommandError, Frontdesk
from talkgrain.operators import chats as chat_list
from talkgrain.session import local_session, read_table, ship
from talkgrain.sources.store import MessageStore


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="talkgrain", description=__doc__)
    p.add_argument("-c", "--clear", action="store_true", help="empty the stores first")
    p.add_argument("-f", "--config", default="talkgrain.yaml", help="configuration file")
    p.add_argument("--debug", action="store_true", help="log more")
    p.add_argument("--tables", help="folder of the tables incoming and dialogs")
    p.add_argument("--cluster", action="store_true", help="take the session spark-submit gives in place of a local one")
    return p


def desks(spark: SparkSession, conf: config.Config, clear: bool = False, tables: str | None = None) -> dict[str, Frontdesk]:
    """A desk for each frontend by its id, over the store of its backend."""
    stores = {b.id: MessageStore(spark, f"{conf.root}/{b.id}", from_scratch=clear) for b in conf.backends}
    backends = {b.id: b for b in conf.backends}
    feeds = (lambda name: read_table(spark, tables, name)) if tables else None
    names = chat_list.titles(feeds("dialogs")) if feeds else spark.createDataFrame([], "chat_id long, title string")
    return {f.id: Frontdesk(stores[f.backend], names, f, backend=backends[f.backend], feeds=feeds, log=lambda m: print(m, file=sys.stderr)) for f in conf.frontends}


def main(argv: list[str] | None = None, lines=sys.stdin) -> None:
    """Each line is a command of the admin to the first frontend."""
    a = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate() if a.cluster else local_session("*")
    if a.cluster:
        ship(spark)
    spark.sparkContext.setLogLevel("DEBUG" if a.debug else "ERROR")
    conf = config.load(a.config)
    desk = next(iter(desks(spark, conf, a.clear, a.tables).values()))
    for line in lines:
        try:
            reply = desk.handle(line, sender=desk.frontend.admin)
        except (CommandError, chat_list.EntityNotFound) as e:
            print(e)
            continue
        if reply:
            print(reply.text)
            if reply.rows is not None:
                reply.rows.show(truncate=False)


if __name__ == "__main__":
    main()
