"""Reading agent traces: response text, span counts, token sums, assessment flags.

Spans and assessments are arrays inside the trace row, so counting them with array functions
needs no explode, no grouping and no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_OUTPUT_TYPE = "array<struct<type:string,content:array<struct<text:string>>>>"


@dataclass(frozen=True)
class SpanNames:
    """Which span names count as what. Fixed values by default."""

    model_calls: tuple[str, ...] = ("call_llm",)
    model_call_suffix: str = "._call_llm"
    tool_prefix: str = "tool."
    tool_names: tuple[str, ...] = ("execute_tool",)
    tools: tuple[tuple[str, str], ...] = (
        ("genie_call_count", "tool.genie_recalls"),
        ("vs_call_count", "tool.vector_search_narrative"),
        ("fetch_tsb_count", "tool.fetch_tsb"),
        ("fetch_investigation_count", "tool.fetch_investigation"),
    )
    token_attribute: str = "mlflow.spanOutputs"
    token_path: str = "$.usage.total_tokens"

    def is_model_call(self, name: Column) -> Column:
        return name.isin(*self.model_calls) | name.endswith(self.model_call_suffix)

    def is_tool_call(self, name: Column) -> Column:
        return name.startswith(self.tool_prefix) | name.isin(*self.tool_names)

    def tokens(self, attributes: Column) -> Column:
        return F.get_json_object(attributes[self.token_attribute], self.token_path).try_cast("int")


def response_text(response: Column | str) -> Column:
    """Text of the first message in a response body; NULL when there is none."""
    body = F.col(response) if isinstance(response, str) else response
    output = F.from_json(F.get_json_object(body.cast("string"), "$.output"), _OUTPUT_TYPE)
    message = F.try_element_at(F.filter(output, lambda o: o["type"] == "message"), F.lit(1))
    return F.try_element_at(message["content"], F.lit(1))["text"]


def any_response_text(outputs: Column | str) -> Column:
    """Text out of the shapes a scorer may be handed as JSON.

    A ``text`` field, a ``content`` string, a nested ``output``, or the head of a list (itself
    a string, or an object with ``text`` or ``content``); anything else is kept as it is.
    """
    raw = F.col(outputs) if isinstance(outputs, str) else outputs
    tries = [
        F.get_json_object(raw, path)
        for path in (
            "$.text",
            "$.output.text",
            "$.output[0].text",
            "$.output[0].content[0].text",
            "$[0].text",
            "$[0].content[0].text",
        )
    ]
    plain = [
        F.try_variant_get(F.try_parse_json(raw), path, "string")
        for path in ("$.content", "$.output.content", "$.output", "$[0].content", "$[0]")
    ]
    scalars = [F.when(~F.coalesce(p, F.lit("")).rlike(r"\A\s*[\[{]"), p) for p in plain]
    return F.coalesce(*tries, *scalars, raw, F.lit(""))


def count_spans(spans: Column, test) -> Column:
    return F.size(F.filter(spans, test)).cast("bigint")


def span_counts(spans: Column, names: SpanNames = SpanNames()) -> dict[str, Column]:
    """The per-trace counters, each one pass over the array."""
    counters = {
        "call_llm_exec_count": count_spans(spans, lambda s: names.is_model_call(s["name"])),
        "tool_call_count": count_spans(spans, lambda s: names.is_tool_call(s["name"])),
    }
    for label, tool in names.tools:
        counters[label] = count_spans(spans, _is_named(tool))
    return counters


def _is_named(tool: str):
    return lambda span: span["name"] == tool


def token_total(spans: Column, names: SpanNames = SpanNames()) -> Column:
    """Tokens over the model-call spans.

    Other spans add 0 and unreadable values add nothing, so the total is NULL only when every
    span is a model call without a readable count.
    """
    values = F.filter(
        F.transform(
            spans,
            lambda s: F.when(names.is_model_call(s["name"]), names.tokens(s["attributes"])).otherwise(F.lit(0)),
        ),
        lambda v: v.isNotNull(),
    )
    total = F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, v: acc + v.cast("bigint"))
    return F.when(F.size(values) > 0, total)


def assessment_value(assessments: Column, name: str) -> Column:
    return F.try_element_at(F.filter(assessments, lambda a: a["name"] == name), F.lit(1))["feedback"]["value"]


def flag(assessments: Column, name: str) -> Column:
    """1 when the stored value is ``true``, else 0, also when it is missing."""
    return F.when(assessment_value(assessments, name) == "true", F.lit(1)).otherwise(F.lit(0))


def judged(assessments: Column, name: str) -> Column:
    """1 for ``"yes"``, 0 for ``"no"`` (the stored values carry their JSON quotes), else NULL."""
    value = assessment_value(assessments, name)
    return F.when(value == '"yes"', F.lit(1)).when(value == '"no"', F.lit(0))
