"""Documents mixed by source to target weights, sized in tokens, with capped repeats.

The target total flows down a tree of domain, language and source. Each node gives its children their share by weight;
what a child can't take (its documents times max_repeats are fewer tokens) goes to its siblings first, in proportion
to their weights, and only what a whole subtree can't take reaches the nodes above. A leaf's budget is whole epochs of
its documents and a prefix, in tokens, of one more epoch in a seeded order. The prefix is found by sums over hash
buckets and an exact running sum within the one bucket it ends in, so that no leaf is ordered in one task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkgrain.session import durable

LEVELS = ("domain", "language", "source")
#: Hash buckets of an epoch's order.
BUCKETS = 4096


@cache
def _encoder(path: str | None):
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, id_col: str, text: str, carry: list[str], tokenizer: str | None = None) -> DataFrame:
    """id, carried columns and the tokens of the text; null texts are left out, empty ones have none. tokenizer: a rank file."""
    src = df.where(F.col(text).isNotNull()).select(F.col(id_col), *carry, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name != "_text") + ", tokens long"
    names = [f.name for f in src.schema.fields if f.name != "_text"] + ["tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=names)

    return src.mapInArrow(run, schema)


@dataclass
class Node:
    """weight among its siblings; capacity in tokens of all below; budget as assigned."""

    name: str
    weight: float = 0.0
    capacity: float = 0.0
    budget: float = 0.0
    children: dict[str, Node] = field(default_factory=dict)


def tree(leaves: Mapping[tuple[str, ...], tuple[float, float]]) -> Node:
    """The tree of leaves by path, each with weight and capacity; inner nodes hold the sums."""
    root = Node("")
    for path, (weight, capacity) in sorted(leaves.items()):
        node = root
        for name in (None, *path):
            node = node if name is None else node.children.setdefault(name, Node(name))
            node.weight += weight
            node.capacity += capacity
    return root


def spread(node: Node, budget: float) -> float:
    """Assign a budget to a node and all below; returns what it can't take."""
    node.budget = min(budget, node.capacity)
    left, open_ = node.budget, [c for c in node.children.values() if c.capacity > 0]
    given = dict.fromkeys((c.name for c in open_), 0.0)
    while open_ and left > 1e-6:
        total = sum(c.weight for c in open_)
        parts = {c.name: left * (c.weight / total if total else 1 / len(open_)) for c in open_}
        left = 0.0
        for c in open_:
            room = c.capacity - given[c.name]
            given[c.name] += min(parts[c.name], room)
            left += max(0.0, parts[c.name] - room)
        open_ = [c for c in open_ if c.capacity - given[c.name] > 1e-6]
    for c in node.children.values():
        spread(c, given.get(c.name, 0.0))
    return budget - node.budget


def _leaves(node: Node, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], Node]]:
    if not node.children:
        yield path, node
    for c in node.children.values():
        yield from _leaves(c, (*path, c.name))


def mixture(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7, tokenizer: str | None = None, domains: Mapping[str, str] | None = None) -> DataFrame:
    """doc_id, source, language, tokens, copies: documents of the mixture and how often each appears.

    total: tokens of the mixture, by default those of all documents with a target; at most what max_repeats allows.
    domains: of sources, by default what a column `domain` of targets says; a source without one is a domain of its own.
    A document of unknown language counts as language 'none'. Documents without a source or whose source has no target
    are left out, as are null texts and repeats of a doc_id beyond one row each as given; a source without documents
    gets nothing and its share goes to its siblings. A leaf's size is exact to half a document.
    """
    spark = docs.sparkSession
    given = targets.select("source", "target_share", "max_repeats", F.col("domain") if "domain" in targets.columns else F.lit(None).alias("domain")).where("source IS NOT NULL").collect()  # one row a source
    goal = {r["source"]: (r["target_share"] or 0.0, max(0, r["max_repeats"] or 0)) for r in given}
    domains = {r["source"]: r["domain"] for r in given if r["domain"] is not None} if domains is None else domains
    wanted = docs.where(F.col("source").isin(*goal)).select("doc_id", "text", "source", F.coalesce("lang", F.lit("none")).alias("language"))
    sizes = durable(token_counts(wanted, "doc_id", "text", ["source", "language"], tokenizer), "mix-sizes")
    stats = sizes.groupBy("language", "source").agg(F.sum("tokens").alias("tokens")).collect()  # one row a leaf
    whole: dict[str, int] = {}
    for r in stats:
        whole[r["source"]] = whole.get(r["source"], 0) + r["tokens"]
    leaves = {}
    for r in stats:
        share, repeats = goal[r["source"]]
        weight = share * r["tokens"] / whole[r["source"]] if whole[r["source"]] else 0.0
        leaves[domains.get(r["source"], r["source"]), r["language"], r["source"]] = (weight, float(r["tokens"] * repeats))
    root = tree(leaves)
    spread(root, float(sum(whole.values()) if total is None else total))
    plan = []
    for (_, language, source), leaf in _leaves(root) if leaves else ():
        n = next(r["tokens"] for r in stats if (r["language"], r["source"]) == (language, source))
        epochs = min(int(leaf.budget // n), goal[source][1]) if n else 0
        plan.append((language, source, epochs, float(leaf.budget - epochs * n) if epochs < goal[source][1] else 0.0))
    plans = F.broadcast(spark.createDataFrame(plan, "language string, source string, epochs int, rest double"))  # one row a leaf
    key = ["language", "source"]
    rows = sizes.join(plans, key).withColumn("h", F.xxhash64(F.lit(seed), F.col("epochs"), "doc_id")).withColumn("bucket", F.shiftrightunsigned("h", 64 - 12).cast("int"))
    in_bucket = rows.where("rest > 0").groupBy(*key, "bucket").agg(F.sum("tokens").alias("in_bucket"), F.first("rest").alias("rest"))
    before = F.coalesce(F.sum("in_bucket").over(Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most BUCKETS rows a leaf
    ends = in_bucket.withColumn("before", before).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("in_bucket") >= F.col("rest"))).select(*key, F.col("bucket").alias("last"), "before")
    ends = spark.createDataFrame(ends.collect(), ends.schema)  # the bucket a budget ends in: one row a leaf
    placed = rows.join(F.broadcast(ends), key, "left")
    running = F.sum("tokens").over(Window.partitionBy(*key).orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    edge = placed.where(F.col("bucket") == F.col("last")).withColumn("at", F.col("before") + F.coalesce(running, F.lit(0)) + F.col("tokens") / 2)
    edge = edge.withColumn("copies", F.col("epochs") + (F.col("at") < F.col("rest")).cast("int")).drop("at")
    # without such a bucket the budget takes all the leaf, or nothing
    sure = placed.where(F.col("last").isNull() | (F.col("bucket") != F.col("last")))
    sure = sure.withColumn("copies", F.col("epochs") + ((F.col("rest") > 0) & (F.col("last").isNull() | (F.col("bucket") < F.col("last")))).cast("int"))
    return sure.unionByName(edge).where("copies > 0").select("doc_id", "source", "language", "tokens", "copies")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, actual_share, tokens, documents, most_copies: what each source came to."""
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    total = got.agg(F.sum("tokens").alias("total"))
    rows = targets.select("source", "target_share").join(got, "source", "left").crossJoin(total)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select("source", "target_share", zero(F.col("tokens") / F.col("total")).alias("actual_share"), zero("tokens").alias("tokens"), zero("documents").alias("documents"), zero("most_copies").alias("most_copies"))
