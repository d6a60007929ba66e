"""Prompts, chat messages and parsed replies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import fixed, text

QA_SCHEMA = "array<struct<question:string,choices:string,answer:string>>"
INSTRUCTION_SCHEMA = "struct<instruction:string,input:string,output:string>"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def render_instruction(
    instruction: Column | str, guideline: Column | str, input_: Column | str, response: Column | str
) -> Column:
    return text.render(
        fixed.PROMPT_LAYOUT, instruction=instruction, guideline=guideline, input=input_, response=response
    )


def render_choices(question: Column | str, choices: Column | str, preamble: str = "", examples: Column | str | None = None) -> Column:
    """Preamble, example blocks, the question, one "A) text" line per choice, and "Answer:"."""
    shots = F.lit("") if examples is None else F.array_join(F.transform(_c(examples), lambda e: F.concat(e, F.lit("\n"))), "")
    lines = F.array_join(F.transform(_c(choices), lambda c: F.concat(c["choice"], F.lit(") "), c["answer"])), "\n")
    return F.concat(
        F.lit(preamble), shots, F.lit("\nQuestion: "), _c(question), F.lit("\n"),
        F.coalesce(lines, F.lit("")), F.lit("\n\nAnswer:\n"),
    )


def _has(field: str):
    return lambda e: e[field].isNotNull()


def strip_fences(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), "```(json|yaml)?", "")


def parse_fenced(
    df: DataFrame, col: str, schema: str, required: Sequence[str] = (), out: str = "parsed"
) -> tuple[DataFrame, DataFrame]:
    """(rows that parse and have the required fields, the other rows with a reason).

    Both sides filter one labelled frame.
    """
    struct = T.DataType.fromDDL(schema)
    ok = F.lit(True)
    parsed = F.from_json(strip_fences(col), struct, {"mode": "PERMISSIVE"})
    labelled = df.withColumn(out, parsed)
    if isinstance(struct, T.ArrayType):
        elements = F.col(out)
        for f in required:
            ok = ok & F.forall(elements, _has(f))
        ok = F.col(out).isNotNull() & F.coalesce(ok, F.lit(False))
    else:
        for f in required:
            ok = ok & F.col(out)[f].isNotNull()
        ok = F.col(out).isNotNull() & ok
    labelled = labelled.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    good = labelled.where("_ok").drop("_ok")
    bad = labelled.where("NOT _ok").drop("_ok", out).withColumn("reason", F.lit("not the expected JSON"))
    return good, bad


def parse_flat_yaml(c: Column | str) -> Column:
    """`key: value` lines to a map of trimmed strings; other lines are skipped."""
    lines = F.filter(F.split(strip_fences(c), "\n"), lambda l: F.contains(l, F.lit(":")))
    entries = F.transform(
        lines,
        lambda l: F.struct(
            F.trim(F.substring_index(l, ":", 1)), F.trim(F.substring(l, F.instr(l, ":") + 1, F.length(l)))
        ),
    )
    # A repeated key keeps its first value; map_from_entries refuses repeats.
    keys = F.transform(lines, lambda l: F.trim(F.substring_index(l, ":", 1)))
    first = F.filter(entries, lambda e, i: F.array_position(keys, e["col1"]) == i + 1)
    return F.map_from_entries(first)


def flatten_instructions(
    df: DataFrame, raw: str = "response", passage: str = "input", guideline: str = "Return in JSON format"
) -> tuple[DataFrame, DataFrame]:
    """Replies {instruction, input?, output} to rows; a nested output stays as JSON text, and a
    missing input falls back to the passage. Second frame: rejected replies."""
    good, bad = parse_fenced(df, raw, INSTRUCTION_SCHEMA, ["instruction", "output"], "_p")
    rows = good.select(
        F.col("_p.instruction").alias("instruction"), F.lit(guideline).alias("guideline"),
        F.coalesce("_p.input", F.col(passage)).alias("input"), F.col("_p.output").alias("response"),
    )
    return rows, bad


def flatten_qa(df: DataFrame, raw: str = "response", instruction: str = fixed.ANSWER_INSTRUCTION) -> tuple[DataFrame, DataFrame]:
    """Lists of question/answer/choices to rows. The newline after the question stays when
    there are no choices."""
    good, bad = parse_fenced(df, raw, QA_SCHEMA, ["question", "answer"], "_p")
    keep = [c for c in df.columns if c != raw and c not in ("instruction", "guideline", "input", "response")]
    rows = good.select(*keep, F.posexplode("_p").alias("qa_no", "_q")).select(
        *keep, "qa_no", F.lit(instruction).alias("instruction"), F.lit("").alias("guideline"),
        F.concat(text.strip("_q.question"), F.lit("\n"), F.coalesce(F.col("_q.choices"), F.lit(""))).alias("input"),
        text.strip("_q.answer").alias("response"),
    )
    return rows, bad


def to_chat(
    df: DataFrame, system: Column | str, query: str = "query", image: str | None = "image", reply: str | None = "response",
    out: str = "messages",
) -> DataFrame:
    """Messages: system, user, and the reply as assistant when its column exists. One image goes
    before the text; a list of images goes after it."""
    part = lambda kind, value, img: F.struct(
        F.lit(kind).alias("type"), value.cast("string").alias("text"), img.cast("string").alias("image")
    )
    null = F.lit(None)
    words = F.array(part("text", F.col(query), null))
    user = words
    if image and image in df.columns:
        many = isinstance(df.schema[image].dataType, T.ArrayType)
        if many:
            with_img = F.concat(words, F.transform(image, lambda i: part("image", null, i)))
        else:
            with_img = F.concat(F.array(part("image", null, F.col(image))), words)
        user = F.when(F.col(image).isNotNull(), with_img).otherwise(words)
    msg = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    sys_text = F.lit(system) if isinstance(system, str) else system
    msgs = [msg("system", F.array(part("text", sys_text, null))), msg("user", user)]
    if reply and reply in df.columns:
        msgs.append(msg("assistant", F.array(part("text", F.col(reply), null))))
    return df.withColumn(out, F.array(*msgs))


def to_training_text(df: DataFrame, eos: str, out: str = "text") -> DataFrame:
    """instruction + " " + input + " " + response + end marker. A missing column is "", and a
    structured response is written as JSON."""
    def piece(name: str) -> Column:
        if name not in df.columns:
            return F.lit("")
        c = F.col(name)
        if isinstance(df.schema[name].dataType, (T.StructType, T.MapType, T.ArrayType)):
            c = F.to_json(c)
        return F.coalesce(c, F.lit(""))

    return df.withColumn(
        out, F.concat(piece("instruction"), F.lit(" "), piece("input"), F.lit(" "), piece("response"), F.lit(eos))
    )


def with_format_guideline(
    templates: list[dict], layout: str, default: str = fixed.DEFAULT_GUIDELINE
) -> list[dict]:
    """Template rows with the answer's schema text (title and type removed) put into `layout`
    and appended to the guideline, after the example instructions. Templates are a short
    list on the driver; they reach rows as literals or a broadcast table."""
    import json

    out = []
    for t in templates:
        guide = t.get("guideline", default)
        if t.get("examples"):
            guide += "\n ### Instruction Examples: \n" + "".join(f"{e}\n" for e in t["examples"])
        schema = {k: v for k, v in t["schema"].items() if k not in ("title", "type")}
        guide += "\n" + layout.replace("{schema}", json.dumps(schema))
        out.append({**{k: v for k, v in t.items() if k not in ("schema", "examples")}, "guideline": guide})
    return out
