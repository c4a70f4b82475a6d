"""Chat formatting by incremental rendering of a black-box template.

A template is any function from messages to text. It is called on each prefix of a conversation; what
a prefix adds to the one before is the turn's part, and a second call with a marker for the turn's
text tells the text from what the template puts around it. A prefix that does not begin with the one
before shows a template that rewrites history; spans then come from whole renderings.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, parts

Message = tuple[str, str]
START, END = "<|im_start|>", "<|im_end|>"
#: What must not occur in a text as itself.
CONTROLS = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPE = re.compile("|".join(map(re.escape, ("\\", *CONTROLS))))
_UNESCAPE = re.compile(r"\\([\\-])")
MARK = "\ue000text\ue000"  # private-use characters: no template changes them


def escape(text: str) -> str:
    """Doubles backslashes and puts \\- behind the first character of each control string."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\-{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: "\\" if m[1] == "\\" else "", text)


def template(messages: list[Message]) -> str:
    """The default: <|im_start|>role, newline, text, <|im_end|>, newline for each turn; a newline in a role is \\n."""
    return "".join(f"{START}{_role(role)}\n{escape(text)}{END}\n" for role, text in messages)


def _role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def parse(formatted: str) -> list[Message]:
    """The messages that template() was given."""
    out = []
    for turn in formatted.split(START)[1:]:
        role, _, text = turn.removesuffix("\n").removesuffix(END).partition("\n")
        out.append((re.sub(r"\\([\\n-])", lambda m: {"\\": "\\", "n": "\n", "-": ""}[m[1]], role), unescape(text)))
    return out


class Rendering:
    """A conversation rendered turn by turn: `text`, `spans` of each turn's text, `rewrites`.

    The template gets a list of its own at each call, so one that keeps or changes the list does no harm.
    """

    def __init__(self, render: Callable[[list[Message]], str]):
        self.render, self.messages, self.text, self.spans, self.rewrites = render, [], "", [], False

    def add(self, role: str, text: str) -> None:
        old = self.text
        self.messages.append((role, text))
        self.text = self.render(list(self.messages))
        if self.rewrites or not self.text.startswith(old):
            self.rewrites = True
            return
        self.spans.append(self._span(self._marked(len(self.messages) - 1), len(old)))

    def _marked(self, i: int) -> str:
        return self.render([*self.messages[:i], (self.messages[i][0], MARK), *self.messages[i + 1 :]])

    def _span(self, marked: str, start: int) -> tuple[int, int] | None:
        """Where the marker stands in for the turn's text: of the marker's places, the one around which all else is alike."""
        at = marked.find(MARK, start)
        while at >= 0 and marked[start:at] == self.text[start:at]:
            tail = marked[at + len(MARK) :]
            end = len(self.text) - len(tail)
            if end >= at and self.text.endswith(tail):
                return (at, end)
            start, at = at, marked.find(MARK, at + 1)
        return None

    def finish(self) -> None:
        """For a template that rewrites history: each turn's text in the last rendering."""
        if self.rewrites:
            self.spans = [self._span(self._marked(i), 0) for i in range(len(self.messages))]


def format_chats(
    turns: DataFrame,
    *,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    render: Callable[[list[Message]], str] = template,
    learn: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """A row per conversation: cf_id, cf_turns, cf_text, cf_loss (array of struct(start, end), code points), cf_rewrites.

    The loss mask covers the texts of the roles in `learn`, nothing around them. Turns stand by number,
    null ones first, equal ones by role and text. Null text or role: empty. Null conversation: one of
    its own. Rows that repeat are turns that repeat. A turn whose text the template drops or alters
    beyond its place has a null span, and so no loss. Empty table: no rows.

    One task streams a conversation's turns in order and holds that conversation only.
    """
    kind = dict(turns.dtypes)[conv_id]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cf_id", "cf_turns", "cf_text", "cf_loss", "cf_rewrites"]
        loss_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        done: list[tuple] = []
        now, key, id_type = None, None, pa.int64()

        def close() -> None:
            if now is None:
                return
            now.finish()
            loss = [{"start": s[0], "end": s[1]} for (r, _), s in zip(now.messages, now.spans, strict=True) if r in learn and s]
            done.append((key, len(now.messages), now.text, loss, now.rewrites))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            kinds = [id_type, pa.int64(), pa.string(), loss_type, pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for k, r, t in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if now is None or k != key:
                    close()
                    now, key = Rendering(render), k
                now.add(r or "", t or "")
            if len(done) >= 256:
                yield batch_of(done)
                done = []
        close()
        if done:
            yield batch_of(done)

    rows = turns.select(F.col(conv_id).alias("cf_id"), F.col(turn).alias("n"), F.col(role).alias("r"), F.col(text).alias("t"))
    rows = rows.repartition(parts(turns), "cf_id").sortWithinPartitions("cf_id", "n", "r", "t")
    loss = "array<struct<start: int, end: int>>"
    return rows.mapInArrow(work, f"cf_id {kind}, cf_turns long, cf_text string, cf_loss {loss}, cf_rewrites boolean")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns, sha, loss_chars, loss_sha, chars = [], [], [], [], []
            for formatted, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                back = parse(formatted)
                turns.append(len(back))
                sha.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in back).encode()).hexdigest())
                loss = "".join(unescape(formatted[s["start"] : s["end"]]) for s in spans)
                loss_chars.append(len(loss))
                loss_sha.append(hashlib.sha256(loss.encode()).hexdigest())
                chars.append(len(formatted))
            cols = [batch.column(0), *(pa.array(x) for x in (turns, sha, loss_chars, loss_sha, chars))]
            yield pa.RecordBatch.from_arrays(
                [c.cast(t) for c, t in zip(cols, (cols[0].type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    kind = dict(turns.dtypes)["conv_id"]
    return format_chats(turns.unionByName(more)).select("cf_id", "cf_text", "cf_loss").mapInArrow(
        digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


OP6_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(text) + length(regexp_replace(regexp_replace(text, '[^\\]', '', 'g'), '\\', '.', 'g'))
    + 2 * len(regexp_extract_all(text, '<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|</?s>|\[/?INST\]|<</?SYS>>')) AS escaped FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length(role) + 1 + escaped + 10 + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
