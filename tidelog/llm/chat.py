"""Conversations as token sequences with a loss mask, assembled from separately encoded segments."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.tokens import encoder, id_bytes

#: What the reserved ids look like in text; they follow the vocabulary's ids in this order.
MARKS = ("### ", ": ", "</turn>\n")
TURNS = "conv_id long, turn long, role_order string, ids binary, n_tokens long, mask_from long, mask_to long"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_TEMPLATE = ("###", "</turn>")


class Escapes:
    """Escapes of control strings: those of the template and every added token of the vocabulary.

    A backslash goes behind the first character of each place where a control string begins, so
    none is left in the escaped text, and every backslash of the content is doubled. In roles a
    colon gets a backslash before it. Control strings are at least two characters and hold no
    backslash; a vocabulary with others is refused.
    """

    def __init__(self, tokens: Iterable[str] = ()):
        controls = sorted({*_TEMPLATE, *tokens})
        if bad := [c for c in controls if len(c) < 2 or "\\" in c]:
            raise ValueError(f"control strings that can't be escaped: {bad}")
        split = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in controls)
        self.text, self.role = re.compile(rf"\\|{split}"), re.compile(rf"\\|:|{split}")

    @classmethod
    def of(cls, tokenizer: str) -> Escapes:
        return cls(t.content for t in encoder(tokenizer).tokenizer.get_added_tokens_decoder().values())

    def escape(self, text: str, role: bool = False) -> str:
        return self.role.sub(lambda m: "\\:" if m[0] == ":" else m[0] + "\\", text) if role else self.text.sub(lambda m: m[0] + "\\", text)


_BACKSLASH = re.compile(r"\\(\\?)")


def unescape(text: str) -> str:
    """Of two backslashes one stays, and a single one goes."""
    return _BACKSLASH.sub(r"\1", text)


def format_turns(turns: DataFrame, tokenizer: str) -> DataFrame:
    """One row a turn with its ids (little-endian 32-bit) and its place in its conversation.

    A turn is: reserved id, role, reserved id, text, reserved id. Role and text are escaped and
    encoded each by itself, so no content can make or change a reserved id, nor an id of the
    vocabulary's own special tokens (see :class:`Escapes`). ``start`` is the
    number of the conversation's tokens before the turn, by a prefix sum over its turns, and
    ``loss_from`` to ``loss_to`` is what the loss covers: the text of a turn whose role is
    ``assistant``, no mark. Turns are encoded where they are read; only then are conversations
    brought together and sorted by turn, and ties by role and ids. A null turn comes first, a null
    role or text is empty, a null conv_id is a conversation; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, escape = encoder(tokenizer), Escapes.of(tokenizer).escape
        mark = [np.array([enc.size + i], "<u4") for i in range(len(MARKS))]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                conv, turn, role, text = (c.slice(at, 512) for c in batch.columns)
                roles = [r or "" for r in role.to_pylist()]
                names = enc.encode([escape(r, True) for r in roles])
                bodies = enc.encode([escape(t or "") for t in text.to_pylist()])
                ids, lengths, lo, hi = [], [], [], []
                for r, name, body in zip(roles, names, bodies, strict=True):
                    parts = [mark[0], name, mark[1], body, mark[2]]
                    ends = np.cumsum([len(p) for p in parts])
                    ids.append(np.concatenate(parts).tobytes())
                    lengths.append(int(ends[-1]))
                    lo.append(int(ends[2]))
                    hi.append(int(ends[3]) if r == "assistant" else int(ends[2]))
                yield pa.RecordBatch.from_arrays([conv, turn, pa.array(roles), pa.array(ids, pa.binary()), *(pa.array(x, pa.int64()) for x in (lengths, lo, hi))], [x.split()[0] for x in TURNS.split(", ")])

    order = ["turn", "role_order", "ids"]
    coded = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).mapInArrow(run, TURNS)
    before = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return coded.withColumn("start", before).select("conv_id", "turn", "role_order", "start", "n_tokens", (before + F.col("mask_from")).alias("loss_from"), (before + F.col("mask_to")).alias("loss_to"), "ids")


def digests(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """Read formatted turns back and digest each conversation.

    A hash has to take its turns in order, so a conversation is one stream within a task; turns
    pass one at a time and nothing is kept but the hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, size = id_bytes(tokenizer), encoder(tokenizer).size
        names = [x.split()[0] for x in DIGEST.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        done: list[tuple] = []
        now: list | None = None

        def text(ids: np.ndarray) -> str:
            return b"".join([table[i] for i in ids.tolist()]).decode("utf-8")

        def close() -> None:
            done.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
            done.clear()
            return batch

        for batch in batches:
            for conv, start, lo, hi, data in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "start", "loss_from", "loss_to", "ids")), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        close()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids = np.frombuffer(data, "<u4")
                first, second, third = np.flatnonzero(ids >= size).tolist()
                role, body = text(ids[first + 1 : second]), text(ids[second + 1 : third])
                now[1] += 1
                now[2].update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                loss = unescape(text(ids[lo - start : hi - start]))
                now[3] += len(loss)
                now[4].update(loss.encode())
                now[5] += len(role) + len(body) + sum(map(len, MARKS))
            if len(done) >= 1000:
                yield out()
        if now is not None:
            close()
        if done:
            yield out()

    rows = formatted.select("conv_id", "turn", "role_order", "start", "loss_from", "loss_to", "ids")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "start").mapInArrow(run, DIGEST)
