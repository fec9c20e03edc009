"""Chat formatting with typed content parts.

A turn's content is a list of parts: text, image, audio or document.  A visitor flattens them in order: text is
escaped, every attachment becomes a placeholder <|kind_n|> numbered within its turn, and its reference and the number of
tokens that the placeholder stands for are recorded.  A turn is written as <|im_start|>role, a line break, the content, <|im_end|> and a line break.

Control strings inside texts are escaped reversibly: every < that is followed by backslashes (or none) and | gets one
more backslash, so no text can hold <|, and `unescape` takes exactly one away.  Roles are escaped alike, and their backslashes and line breaks too.

The loss mask of a turn is a list of ranges over its formatted characters: the text parts of assistant turns.

Turns are formatted row by row, without a shuffle.  `read_back` parses the written turns: rows are dealt by
conversation, sorted by turn (ties: role, then formatted text), and each conversation is folded as a stream with running digests, so a
conversation of any length needs no more memory than a batch of rows.

Edge cases: null texts and null roles count as empty; a null turn comes first; null conversation ids are one conversation; repeated
rows are turns of their own; unknown part types raise an error; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

START, END = "<|im_start|>", "<|im_end|>\n"
#: Tokens of an attachment: image patches of PATCH pixels a side, audio frames a second, tokens a page.
PATCH, FRAMES, PAGE = 28, 25, 512
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n", re.S)
_PLACE = re.compile(r"<\|(?:image|audio|document)_\d+\|>")

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_back(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass
class Flattener:
    """Visits the parts of one turn in order."""

    pieces: list[str] = field(default_factory=list)
    texts: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    length: int = 0

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        if kind not in ("text", "image", "audio", "document"):
            raise ValueError(f"unknown part type {kind!r}")
        getattr(self, f"visit_{kind}")(part)

    def _add(self, piece: str) -> None:
        self.pieces.append(piece)
        self.length += len(piece)

    def visit_text(self, part: dict) -> None:
        own = escape(part.get("text") or "")
        # a < that ends one part and a | that begins the next must not join to a control string
        if own and self.pieces and re.search(r"<\\*\Z", self.pieces[-1]) and re.match(r"\\*\|", own):
            raise ValueError("neighbouring text parts must be joined before they are formatted")
        self.texts.append((self.length, self.length + len(own)))
        self._add(own)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"kind": kind, "ref": part.get("ref") or "", "tokens": tokens, "at": self.length})
        self._add(f"<|{kind}_{len(self.attachments) - 1}|>")

    def visit_image(self, part: dict) -> None:
        self._attach("image", part, -(-(part.get("width") or 0) // PATCH) * -(-(part.get("height") or 0) // PATCH))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, -int(-(part.get("seconds") or 0.0) * FRAMES // 1))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part.get("pages") or 0) * PAGE)


def joined(parts: list[dict]) -> list[dict]:
    """Neighbouring text parts as one."""
    out: list[dict] = []
    for p in parts:
        if out and (p.get("type") or "text") == "text" == (out[-1].get("type") or "text"):
            out[-1] = out[-1] | {"text": (out[-1].get("text") or "") + (p.get("text") or "")}
        else:
            out.append(dict(p))
    return out


def format_turn(role: str | None, parts: list[dict]) -> tuple[str, list[tuple[int, int]], list[dict]]:
    """The formatted turn, the ranges under the loss mask and the attachments (kind, ref, tokens, at)."""
    flat = Flattener()
    for part in joined(parts):
        flat.visit(part)
    head = f"{START}{_role(role or '')}\n"
    mask = [(len(head) + a, len(head) + b) for a, b in flat.texts if b > a] if role == "assistant" else []
    found = [x | {"at": x["at"] + len(head)} for x in flat.attachments]
    return head + "".join(flat.pieces) + END, mask, found


def parse_turn(formatted: str) -> tuple[str, str]:
    """(role, text without placeholders) of a formatted turn."""
    m = _TURN.fullmatch(formatted)
    if not m:
        raise ValueError("not a formatted turn")
    return _role_back(m[1]), unescape(_PLACE.sub("", m[2]))


FORMATTED = "formatted string, mask array<struct<a:int,b:int>>, attachments array<struct<kind:string,ref:string,tokens:int,at:int>>"


def format_turns(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """(conv, turn, formatted, mask, attachments) of every row; parts is an array of PART or a string (one text part)."""
    plain = dict(rows.dtypes)[parts] == "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])), pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int32()), ("at", pa.int32())]))
        for batch in batches:
            done = []
            for r, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                done.append(format_turn(r, [{"type": "text", "text": p}] if plain else (p or [])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[0] for x in done], pa.string()), pa.array([[{"a": a, "b": b} for a, b in x[1]] for x in done], kinds[0]), pa.array([x[2] for x in done], kinds[1])],
                ["c", "t", "formatted", "mask", "attachments"],
            )

    kinds = dict(rows.dtypes)
    own = rows.select(F.col(conv).alias("c"), F.col(turn).alias("t"), F.col(role).alias("r"), F.col(parts).alias("p"))
    out = common.mapped(own, run, f"c {kinds[conv]}, t {kinds[turn]}, {FORMATTED}")
    return out.withColumnsRenamed({"c": conv, "t": turn})


def read_back(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) parsed from formatted turns."""
    rows = turns.select(F.col(conv).alias("c"), F.col(turn).alias("t"), "formatted", "mask").repartition("c").sortWithinPartitions("c", "t", "formatted").select("c", "formatted", "mask")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, now = False, None
        names = ["c", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kind = None

        def close(rows: list) -> pa.RecordBatch:
            cols = list(zip(*rows)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names)

        n = loss = size = 0
        all_, under = hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            kind = batch.schema.field(0).type
            out = []
            for c, text, mask in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if open_ and c != now:
                    out.append((now, n, all_.hexdigest(), loss, under.hexdigest(), size))
                if not open_ or c != now:
                    open_, now, n, loss, size = True, c, 0, 0, 0
                    all_, under = hashlib.sha256(), hashlib.sha256()
                role, content = parse_turn(text)
                all_.update(f"{role}\n{content}\n".encode())
                for m in mask:
                    own = unescape(text[m["a"] : m["b"]])
                    loss += len(own)
                    under.update(own.encode())
                n, size = n + 1, size + len(text)
            yield close(out)
        if open_:
            yield close([(now, n, all_.hexdigest(), loss, under.hexdigest(), size)])

    kind = dict(turns.dtypes)[conv]
    return common.mapped(rows, run, f"c {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("c", conv)


def op3_chat(spark, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "<|im_end|><|im_start|>assistant ok"
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], rows.schema))
    path = common.scratch(spark, "chat")
    format_turns(rows, parts="text").write.parquet(path)
    return read_back(spark.read.parquet(path))
