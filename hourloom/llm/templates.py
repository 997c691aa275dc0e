"""Line deduplication with a log-template tree.

A line descends a tree of fixed depth: first by its number of tokens, then by its leading tokens.
Tokens with digits, addresses and links are variable fields from the start.  In a leaf, the distinct lines come in the order
of their first documents; a line that agrees with an earlier template's first line in 70 % of its tokens joins that
template, whichever positions differ, and another one begins a template.  Lines that agree so far share one of a few
fields whole (one more than tokens may differ), so that only lines with an equal field are compared.
A template that occurs in ``min_docs`` documents recurs: its lines are dropped everywhere but in
the first document (smallest doc_id) that has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.durable import stored
from hourloom.llm import spans
from hourloom.llm.removal import KEY, attach, keyed, plain_id

DEPTH = 3
SIMILAR = 70  # per cent of the tokens
MIN_DOCS = 2
_VARIABLE = np.zeros(256, dtype=bool)
_VARIABLE[[*range(ord("0"), ord("9") + 1), ord("@")]] = True
_OPEN = np.uint64(0x5851F42D4C957F2D)


class Lines:
    """The lines of a chunk that have a token: leaf, template, row, number in the row and range of tokens of each."""

    def __init__(self, chunk: spans.Chunk, depth: int = DEPTH):
        words = spans.Words(chunk, lower=False)
        self.tokens = tokens = words.hashes()
        data = chunk.data
        link = np.zeros(len(data), dtype=bool)
        if len(data) > 2:
            link[:-2] = (data[:-2] == ord(":")) & (data[1:-1] == ord("/")) & (data[2:] == ord("/"))
        marks = np.concatenate([[0], np.cumsum(_VARIABLE[data] | link)])
        tokens[marks[words.ends] > marks[words.starts]] = _OPEN
        breaks = np.concatenate([[0], np.cumsum(data == 10)])
        line = breaks[words.starts]
        new = np.ones(len(tokens), dtype=bool)
        new[1:] = (line[1:] != line[:-1]) | (words.rows[1:] != words.rows[:-1])
        self.first = first = np.flatnonzero(new)
        self.last = last = np.append(first[1:], len(tokens))[: len(first)]
        self.rows = words.rows[first]
        self.number = line[first] - breaks[chunk.offsets[:-1]][self.rows]
        lead = np.minimum(first + depth, last)
        self.leaf = spans.mix(spans.prefix_hashes(tokens, first, lead) + (last - first).astype(np.uint64))
        self.template = spans.mix(self.leaf * np.uint64(0x2545F4914F6CDD1D) + spans.prefix_hashes(tokens, lead, last))


def _scan(depth: int):
    schema = pa.schema([("leaf", pa.int64()), ("template", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("line", pa.int32())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = b.column(0).to_numpy(), b.column(1).to_numpy()
            for c in spans.chunks(b.column(2)):
                x = Lines(c, depth)
                fields = {"leaf": x.leaf.view(np.int64), "template": x.template.view(np.int64), "line": x.number.astype(np.int32)}
                own = {"doc_id": ids[c.first + x.rows], "text_key": keys[c.first + x.rows]}
                yield spans.batch({name: (fields | own)[name] for name in schema.names}, schema)

    return scan


def _tokens(depth: int):
    """Token hashes of 32 bits of the distinct lines that go on below the tree."""
    schema = pa.schema([("template", pa.int64()), ("tokens", pa.list_(pa.int32()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in spans.chunks(b.column(2)):
                x = Lines(c, depth)
                long = np.flatnonzero(x.last - x.first > depth)
                template, at = np.unique(x.template[long], return_index=True)
                at = long[at]
                counts = x.last[at] - x.first[at]
                places = np.arange(counts.sum()) + np.repeat(x.first[at] - np.cumsum(counts) + counts, counts)
                values = x.tokens[places].astype(np.uint32).view(np.int32)
                yield spans.batch({"template": template.view(np.int64), "tokens": spans.list_column(values, counts, pa.int32())}, schema)

    return scan


def _gather(depth: int, similar: int):
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines arrive sorted by leaf and first document; (template, leader) of all that join an earlier one."""
        leaf, leaders, places = None, [], {}
        for b in batches:
            found = []
            offsets = b.column(3).offsets.to_numpy()
            values = b.column(3).values.to_numpy()
            for i, (own, template) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
                if own != leaf:
                    leaf, leaders, places = own, [], {}
                tokens = values[offsets[i] : offsets[i + 1]].copy()
                n = len(tokens)
                differ = (100 - similar) * n // 100
                fields = min(differ, n - depth) + 1
                edges = [depth + (n - depth) * k // fields for k in range(fields + 1)]
                keys = [(k, tokens[x:y].tobytes()) for k, (x, y) in enumerate(zip(edges[:-1], edges[1:]))]
                for at in sorted({at for key in keys for at in places.get(key, ())}):
                    if np.count_nonzero(leaders[at][1] != tokens) <= differ:
                        found.append((template, leaders[at][0]))
                        break
                else:
                    for key in keys:
                        places.setdefault(key, []).append(len(leaders))
                    leaders.append((template, tokens))
            yield pa.record_batch([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["template", "leader"])

    return gather


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        marks = b.column(3).to_pylist()
        texts, lines, dropped = [], [], []
        for i, own in enumerate(marks):
            text = b.column(2)[i].as_py()
            parts = [] if text is None else text.split("\n")
            gone = set(own or ())
            texts.append(text if not gone else "\n".join(x for k, x in enumerate(parts) if k not in gone))
            lines.append(len(parts))
            dropped.append(len(gone))
        columns = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
        yield pa.record_batch(columns, names=["doc_id", "text_key", "text", "n_lines", "n_dropped"])


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS, depth: int = DEPTH, similar: int = SIMILAR) -> DataFrame:
    """(doc_id, text_key, marks): the numbers of the lines that go, for documents that lose any; docs: doc_id, text_key, text.

    First documents are stored, so that their join stands alone in its stage and a template that very many documents have is divided
    between tasks at run time.
    """
    lines = stored(docs.mapInArrow(_scan(depth), "leaf bigint, template bigint, doc_id bigint, text_key bigint, line int"), "lines")
    distinct = lines.groupBy("leaf", "template").agg(F.min("doc_id").alias("first"))
    shared = lines.groupBy("leaf").agg(F.min("template").alias("low"), F.max("template").alias("high")).where("low <> high")
    wanted = stored(distinct.join(shared.select("leaf"), "leaf"), "leaves")
    tokens = docs.mapInArrow(_tokens(depth), "template bigint, tokens array<int>").join(wanted, "template")
    tokens = tokens.groupBy("leaf", "first", "template").agg(F.first("tokens").alias("tokens"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tokens.repartition(parts, "leaf").sortWithinPartitions("leaf", "first", "template")
    leaders = stored(dealt.mapInArrow(_gather(depth, similar), "template bigint, leader bigint"), "leaders")
    named = lines.join(leaders, "template", "left").select(F.coalesce("leader", "template").alias("template"), *KEY, "line")
    per_doc = named.groupBy("template", *KEY).agg(F.collect_set("line").alias("lines"))
    per_doc = stored(per_doc, "templates")
    document = F.struct(*KEY)
    recurring = per_doc.groupBy("template").agg(F.count(F.lit(1)).alias("n"), F.min(document).alias("first")).where(F.col("n") >= min_docs)
    gone = per_doc.join(stored(recurring.select("template", "first"), "recurring"), "template").where(document != F.col("first"))
    return gone.groupBy(*KEY).agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("marks"))


def drop_template_lines(docs: DataFrame, min_docs: int = MIN_DOCS, depth: int = DEPTH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, text without the dropped lines, n_lines, n_dropped.

    Lines are what \\n separates; lines without a token are never dropped.  A null text stays null with
    no lines, an empty one has one line.  Rows without a doc_id come first, in an order by their texts.  Rows that share doc_id and
    text are one document; rows that share a doc_id alone are judged each on its own text.  Other columns are not looked at.
    """
    docs = keyed(docs, id_column, text_column)
    marked = attach(docs, dropped_lines(docs, min_docs, depth))
    return marked.mapInArrow(_cut, "doc_id bigint, text_key bigint, text string, n_lines bigint, n_dropped bigint").select(plain_id(), "text", "n_lines", "n_dropped")
