"""Chat formatting with compiled templates.

Conversations are dealt by id and stream through a task in the order of their
turns; each is rendered by a template (see ``template``) whose ``generation``
blocks say what a model is to learn. Control strings inside texts are escaped
reversibly, so the turns can be read back from the output.

A conversation is rendered in memory as a whole; there is no other limit to the
number of its turns.

Edge cases: null texts and roles are empty; null turns come first; rows that tie
in turn are ordered by role, then text, and all are kept. Rows without conv_id
make one conversation of their own with a null id. Extra columns are ignored;
empty input gives no conversations.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.llm.shared import gathered, run_starts, sorted_runs, tidy
from terracell.llm.template import Template, unescape, unescape_line

CHAT = """
{%- for m in messages -%}
{{ '<|im_start|>' ~ (m.role | escape_line) ~ '\\n' }}
{%- if m.role == 'assistant' -%}
{% generation %}{{ m.text | escape }}{% endgeneration %}
{%- else -%}
{{ m.text | escape }}
{%- endif -%}
{{ '<|im_end|>' ~ '\\n' }}
{%- endfor -%}
"""
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def format_conversations(rows: DataFrame, template: str = CHAT, most_chars: int | None = None) -> DataFrame:
    """(conv_id, n_turns, formatted, spans): spans are the generated parts of ``formatted``.

    ``most_chars`` bounds a conversation's output under a template that is not
    trusted; ``CHAT`` writes each text once, so it needs no bound.
    """
    Template(template)  # a wrong template fails here, not in a task
    none = F.col("conv_id").isNull().alias("none")
    turns = rows.select(none, F.coalesce(F.col("conv_id").cast("bigint"), F.lit(0)).alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    keys = ["none", "conv"]

    def run(batches):
        compiled = Template(template, most_chars)
        for t in sorted_runs(batches, keys):
            begin = run_starts(t, keys).tolist()
            none, conv = t.column("none"), t.column("conv")
            role, text = t.column("role").to_pylist(), t.column("text").to_pylist()
            out = [[], [], [], []]
            for lo, hi in zip(begin, [*begin[1:], t.num_rows], strict=True):
                formatted, spans = compiled.render(messages=[{"role": r, "text": x} for r, x in zip(role[lo:hi], text[lo:hi], strict=True)])
                out[0].append(None if none[lo].as_py() else conv[lo].as_py())
                out[1].append(hi - lo)
                out[2].append(formatted)
                out[3].append([{"start": a, "end": b} for a, b in spans])
            kinds = (pa.int64(), pa.int64(), pa.string(), _SPAN)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["conv_id", "n_turns", "formatted", "spans"])

    return gathered(turns, keys, ["turn", "role", "text"]).mapInArrow(tidy(run), "conv_id bigint, n_turns bigint, formatted string, spans array<struct<start:bigint,end:bigint>>")


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a text that ``CHAT`` made."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        out.append((unescape_line(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return out


def learned(formatted: str, spans: list[tuple[int, int]]) -> str:
    """The text under the loss mask, unescaped."""
    return "".join(unescape(formatted[a:b]) for a, b in spans)


def report(rows: DataFrame) -> DataFrame:
    """Digests of what reads back from each formatted conversation."""
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for conv, formatted, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_back(formatted)
                loss = learned(formatted, [(s["start"], s["end"]) for s in spans])
                row = (conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(formatted))
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return format_conversations(rows).select("conv_id", "formatted", "spans").mapInArrow(tidy(run), schema)
