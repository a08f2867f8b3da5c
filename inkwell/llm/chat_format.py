"""Chat formatting by columnar byte assembly.

A conversation becomes one string: for every turn ``### `` role ``:\\n`` text ``</turn>\\n``. Inside role and
text each ``\\``, ``#``, ``<`` and ``:`` of a role (``\\``, ``#``, ``<`` of a text) is preceded by a backslash, so no control string can arise from
content and the way back is exact. Segment lengths, cumulative offsets and scatter indices are computed in
numpy for a whole batch of turns, and all bytes are copied into one preallocated Arrow buffer.

Defined cases: null text or role is empty; turns with the same number are ordered by role, then text; an
empty table gives an empty result; rows with a null conversation id form one conversation with a null id.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, load

# Fixed values of the template.
OPEN, MIDDLE, CLOSE = b"### ", b":\n", b"</turn>\n"
ESCAPED_IN_TEXT, ESCAPED_IN_ROLE = b"\\#<", b"\\#<:"
#: Bytes of a batch's formatted text, about; one conversation is never cut.
BATCH_BYTES = 8 << 20

SCHEMA = "conv_id long, n_turns long, formatted string, loss array<struct<start:long,length:long>>"
_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))])


def _escaped(data: np.ndarray, offsets: np.ndarray, chars: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets with a backslash before each of ``chars``: a scatter of bytes to their shifted places."""
    table = np.zeros(256, np.int64)
    table[list(chars)] = 1
    extra = table[data]
    shift = np.cumsum(extra)
    out = np.full(len(data) + (int(shift[-1]) if len(data) else 0), ord("\\"), np.uint8)
    out[np.arange(len(data)) + shift] = data
    before = np.concatenate([[0], shift])
    return out, offsets + before[offsets]


def _scatter(out: np.ndarray, starts: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    lengths = np.diff(offsets)
    out[np.repeat(starts - offsets[:-1], lengths) + np.arange(len(data))] = data


def assemble(conv: np.ndarray, valid: np.ndarray, roles: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """Format whole conversations, rows of one standing together in order."""
    n = len(conv)
    role, role_at = _escaped(*buffers(roles), ESCAPED_IN_ROLE)
    text, text_at = _escaped(*buffers(texts), ESCAPED_IN_TEXT)
    fixed = [np.frombuffer(x, np.uint8) for x in (OPEN, MIDDLE, CLOSE)]
    lengths = np.stack([np.full(n, len(OPEN)), np.diff(role_at), np.full(n, len(MIDDLE)), np.diff(text_at), np.full(n, len(CLOSE))], 1)
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    starts = ends - lengths
    out = np.empty(int(ends[-1, -1]), np.uint8)
    for k, piece in zip((0, 2, 4), fixed, strict=True):
        out[starts[:, k][:, None] + np.arange(len(piece))] = piece
    _scatter(out, starts[:, 1], role, role_at)
    _scatter(out, starts[:, 3], text, text_at)
    first = np.flatnonzero(np.concatenate([[True], (conv[1:] != conv[:-1]) | (valid[1:] != valid[:-1])]))
    bounds = np.concatenate([starts[first, 0], ends[-1:, -1]])
    # loss spans are in code points from the conversation's start
    chars = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    marked = np.flatnonzero(np.array([r == "assistant" for r in roles.to_pylist()], bool))
    owner = np.searchsorted(first, marked, "right") - 1
    spans = pa.StructArray.from_arrays([pa.array(chars[starts[marked, 3]] - chars[bounds[owner]]), pa.array(chars[ends[marked, 3]] - chars[starts[marked, 3]])], ["start", "length"])
    loss_at = np.searchsorted(owner, np.arange(len(first) + 1)).astype(np.int32)
    formatted = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary()).cast(pa.string())
    ids = pa.array(conv[first], pa.int64(), mask=~valid[first])
    turns = pa.array(np.diff(np.concatenate([first, [n]])), pa.int64())
    return pa.RecordBatch.from_arrays([ids, turns, formatted, pa.ListArray.from_arrays(pa.array(loss_at), spans)], schema=_ARROW)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = 0

    def whole(table: pa.Table, last: bool):
        """The conversations that are complete, and the rows of the one that may go on."""
        table = table.combine_chunks()
        conv, valid = table["conv_id"].fill_null(0).to_numpy(), table["conv_id"].is_valid().to_numpy()
        cut = len(conv)
        if not last and cut:
            same = (conv == conv[-1]) & (valid == valid[-1])
            cut = len(conv) - int(np.argmin(same[::-1])) if not same.all() else 0
        done = assemble(conv[:cut], valid[:cut], table["role"].combine_chunks()[:cut] if cut < len(conv) else table["role"].combine_chunks(), table["text"].combine_chunks()[:cut] if cut < len(conv) else table["text"].combine_chunks()) if cut else None
        return done, table.slice(cut)

    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= BATCH_BYTES:
            done, rest = whole(pa.Table.from_batches(held), False)
            if done is not None:
                yield done
            held = rest.to_batches()
            size = 0  # a conversation that goes on is joined to the next BATCH_BYTES
    if held and sum(map(len, held)):
        done, _ = whole(pa.Table.from_batches(held), True)
        yield done


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows to one row per conversation: formatted text and loss spans in code points."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(_format, SCHEMA)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The way back: (role, text) of each turn."""
    turns, i = [], 0
    while i < len(formatted):
        if not formatted.startswith("### ", i):
            raise ValueError("a turn doesn't begin with its mark")
        role, i = _until(formatted, i + 4, ":\n")
        text, i = _until(formatted, i, "</turn>\n")
        turns.append((role, text))
    return turns


def _until(s: str, i: int, stop: str) -> tuple[str, int]:
    parts = []
    while True:
        end, esc = s.index(stop, i), s.find("\\", i)
        if esc < 0 or end < esc:
            parts.append(s[i:end])
            return "".join(parts), end + len(stop)
        parts.append(s[i:esc] + s[esc + 1])
        i = esc + 2


def unescape(s: str) -> str:
    parts, i = [], 0
    while (esc := s.find("\\", i)) >= 0:
        parts.append(s[i:esc] + s[esc + 1])
        i = esc + 2
    return "".join(parts) + s[i:]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for b in batches:
        rows = []
        for conv, formatted, loss in zip(b["conv_id"].to_pylist(), b["formatted"].to_pylist(), b["loss"].to_pylist(), strict=True):
            turns = parse(formatted)
            learned = "".join(unescape(formatted[x["start"] : x["start"] + x["length"]]) for x in loss)
            rows.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(formatted)))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=names)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted text and its loss mask say, read from the output alone."""
    return formatted.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "\\### Assistant: </turn> ok"
    more = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role")))).alias("x")).select("conv_id", "x.turn", "x.role", F.lit(hard).alias("text"))
    return read_back(format_chats(load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)))


OP8_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) AS tc, length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) AS rc FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(tc + rc + 14) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
