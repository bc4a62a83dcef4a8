"""Chat formatting with compiled templates, and reading the formatted text back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table
from .template import Rendered, compile_template

#: Strings that mean something to the template or to common chat models. In a text each is written as ESCAPE and its letter.
CONTROL = {"<|turn|>": "a", "<|text|>": "b", "<|end|>": "c", "</s>": "d", "<s>": "e", "[/INST]": "f", "[INST]": "g", "<</SYS>>": "h", "<<SYS>>": "i", "<|im_start|>": "j", "<|im_end|>": "k", "<|endoftext|>": "l"}
ESCAPE = "\x10"
TEMPLATE = """{%- for m in messages -%}
<|turn|>{{ m.role | escape }}<|text|>
{%- if m.role == 'assistant' -%}{% generation %}{{ m.text | escape }}{% endgeneration %}{%- else -%}{{ m.text | escape }}{%- endif -%}
<|end|>{{ "\\n" }}
{%- endfor -%}"""

_back = {v: k for k, v in CONTROL.items()} | {"0": ESCAPE}


def escape(text: Any) -> str:
    """``text`` without control strings; ``unescape`` gives it back. The escape character itself is escaped first."""
    text = ("" if text is None else str(text)).replace(ESCAPE, ESCAPE + "0")
    for string, letter in CONTROL.items():
        text = text.replace(string, ESCAPE + letter)
    return text


def unescape(text: str) -> str:
    return re.sub(ESCAPE + "(.)", lambda m: _back[m[1]], text)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a text formatted by ``TEMPLATE``."""
    turns = []
    for turn in formatted.split("<|turn|>")[1:]:
        role, text = turn.removesuffix("<|end|>\n").split("<|text|>")
        turns.append((unescape(role), unescape(text)))
    return turns


SCHEMA = "conv_id long, n_turns long, formatted string, loss_spans array<struct<start:long,stop:long>>"


def format_conversations(rows: DataFrame, template: str = TEMPLATE, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted (whole text), loss_spans (start, stop in code points of what is under the loss mask).

    Rows go by turn; rows of the same turn by role and text, nulls first, and repeated rows are turns of their own. A null role or text is
    empty. Rows with a null id are one conversation with a null id. Empty input: no rows. A conversation is one output row, so a task
    holds one at a time; conversations are dealt by id and streamed through in sorted order.
    """
    return _by_conversation(rows, template, SCHEMA, lambda c, n, r: (c, n, r.text, [{"start": a, "stop": b} for a, b in r.spans]), id_col, turn_col, role_col, text_col)


def _by_conversation(rows: DataFrame, template: str, schema: str, make: Callable[[Any, int, Rendered], tuple], id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    plain = pick(rows, id_col, turn_col, role_col, text_col).toDF("c", "t", "r", "x").withColumn("c", F.col("c").cast("long"))
    dealt = plain.repartition("c").sortWithinPartitions("c", "t", "r", "x").select("c", "r", "x")
    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, {"escape": escape})
        held: list[dict] = []
        now: Any = None
        done: list[tuple] = []

        def close() -> None:
            if held:
                done.append(make(now, len(held), render(messages=held)))

        for b in batches:
            for c, r, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if held and c != now:
                    close()
                    held = []
                now = c
                held.append({"role": r or "", "text": x or ""})
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(v, k.type) for v, k in zip(zip(*done), kinds)], schema=kinds)
                done = []
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(v, k.type) for v, k in zip(zip(*done), kinds)], schema=kinds)

    return dealt.mapInArrow(run, schema)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest(conv: Any, n: int, r: Rendered) -> tuple:
    text = r.text
    turns = read_back(text)
    loss = "".join(unescape(text[a:b]) for a, b in r.spans)
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    return conv, len(turns), sha("".join(f"{role}\n{t}\n" for role, t in turns)), len(loss), sha(loss), len(text)


def op7_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-7, i, r, "</s>[INST] ok [/INST]") for i, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    rows = pick(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text").union(own)
    return _by_conversation(rows, TEMPLATE, DIGEST, digest, "conv_id", "turn", "role", "text")


def _sql_escape(c: str) -> str:
    out = f"replace({c}, chr(16), chr(16) || '0')"
    for string, letter in CONTROL.items():
        out = f"replace({out}, '{string}', chr(16) || '{letter}')"
    return out


ORACLE = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, {len("<|turn|><|text|><|end|>") + 1} + length({_sql_escape("role")}) + length({_sql_escape("text")}) AS n FROM c),
a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, sum(n)::BIGINT AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM a
"""
