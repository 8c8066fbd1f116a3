"""A language model's passes over documents: one row per document throughout, one Arrow stage per pass.

Prompts are built and replies are read by JVM expressions; only prompts go to Python.  A pass that fails clears
nothing.  Each read of `layer` calls the model anew: write it once and read that.
"""

from __future__ import annotations

import base64
import io
import json
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwarden import schemas
from inkwarden.functions import text as T
from inkwarden.operators import semantic
from inkwarden.operators.report import FIELDS
from inkwarden.sources import spans

# Rounds of the analysis, text and findings that a pass is shown, images of a document, their size,
# and the lines that a rewrite adds to the changes.
ROUNDS = 6
CLASSIFIED, REWRITTEN = 3000, 6000
SHOWN = {"narrate": 20, "rewrite": 15}
MOST_IMAGES = 10
LONGEST_SIDE, JPEG_QUALITY = 1568, 85
MORE_REMOVED = "LLM semantic pass neutralized %d additional injection(s)"
EMPTY_REWRITE = "LLM sanitization pass returned empty — exact-match replacements retained"
FAILED_REWRITE = "LLM sanitization pass failed — exact-match replacements applied only"

REPLY = "struct<ok:boolean,calls:array<map<string,string>>>"


class Model(Protocol):
    """ask(task, conversations) gives, per conversation, the list of the model's calls, or None if it failed.

    task: classify, analyse, review, vision, narrate or rewrite.  A conversation is a list of messages with a role
    and text, an image in base64 with its media_type, or the calls and results of earlier rounds.  Calls are dicts
    with a tool: `type` (document_type, description, expected_content), `flag` (severity, confidence, category,
    evidence, location, reasoning, attack_vector), `benign`, `dismiss` (index), `risk` (risk_narrative,
    attack_scenario, remediation, attack_sophistication) or `text` (text).  An empty list ends the analysis.
    """

    name: str

    def ask(self, task: str, conversations: list[list[dict]]) -> list[list[dict] | None]: ...


def talk(model: Model, task: str, conversations: list[list[dict]], rounds: int = 1) -> list[str]:
    """JSON of REPLY per conversation: the calls of all rounds, and whether the last round succeeded."""
    calls: list[list[dict]] = [[] for _ in conversations]
    ok, going = [False] * len(conversations), list(range(len(conversations)))
    for _ in range(rounds):
        if not going:
            break
        try:
            replies = model.ask(task, [conversations[i] for i in going])
        except Exception:  # the model's trouble is a status of the documents, not a failed job
            replies = [None] * len(going)
        for i, reply in zip(list(going), replies, strict=True):
            ok[i] = reply is not None
            calls[i] += reply or []
            if reply:
                known = [{"tool": c.get("tool"), "result": "noted" if c.get("tool") in ("flag", "benign") else "unknown tool"} for c in reply]
                conversations[i] += [{"role": "assistant", "calls": reply}, {"role": "user", "results": known}]
            else:
                going.remove(i)
    return [json.dumps({"ok": o, "calls": c}, default=str) for o, c in zip(ok, calls, strict=True)]


def asked(model: Model, task: str, prompt: Column, rounds: int = 1) -> Column:
    """The reply to a prompt; null for a null prompt, which isn't sent."""

    @F.pandas_udf("string")
    def ask(prompts: pd.Series) -> pd.Series:
        sent = prompts.dropna()
        replies = talk(model, task, [[{"role": "user", "text": p}] for p in sent], rounds)
        return pd.Series(replies, index=sent.index, dtype=object).reindex(prompts.index).replace({float("nan"): None})

    # Not deterministic, so that no optimisation asks twice.
    return F.from_json(ask.asNondeterministic()(prompt), REPLY)


def _field(call: Column, name: str, default: str = "") -> Column:
    return F.coalesce(F.try_element_at(call, F.lit(name)), F.lit(default))


def _calls(reply: Column, tool: str) -> Column:
    return F.filter(F.coalesce(reply["calls"], F.array().cast("array<map<string,string>>")), lambda c: _field(c, "tool") == tool)


def flagged(reply: Column, location: Column | None = None, vector: str | None = None) -> Column:
    """array of schemas.FINDING, coerced to their domains."""

    def row(c: Column) -> Column:
        where = F.concat(F.lit("image:"), location) if location is not None else _field(c, "location", "semantic_layer")
        values = {
            "layer": F.lit("semantic"), "severity": T.coerce_severity(_field(c, "severity", "medium")), "category": _field(c, "category", "semantic_injection"),
            "description": T.left(_field(c, "reasoning"), 500), "evidence": T.left(_field(c, "evidence"), 500), "location": where,
            "confidence": T.coerce_confidence(F.try_element_at(c, F.lit("confidence"))), "reasoning": T.left(_field(c, "reasoning"), 1000),
            "attack_vector": _field(c, "attack_vector") if vector is None else F.lit(vector),
        }
        return F.struct(*(values[n].alias(n) for n in FIELDS))

    return F.transform(_calls(reply, "flag"), row).cast(f"array<{schemas.FINDING}>")


def shown(findings: Column, most: int | None = None, evidence: int = 200) -> Column:
    """Findings as numbered lines, the first `most` of them."""
    rows = findings if most is None else F.slice(findings, 1, most)
    line = lambda f, i: F.concat(F.lit("["), i.cast("string"), F.lit("] ["), F.upper(f.severity), F.lit("] "), f.category, F.lit(" @ "), f.location, F.lit(": "), T.left(f.evidence, evidence), F.lit(" | "), T.left(f.reasoning, evidence))
    return F.array_join(F.transform(rows, line), "\n")


def prepare(content: bytes, media_type: str) -> tuple[str, str]:
    """(base64, media type) of an image, shrunk to LONGEST_SIDE where an imaging library is installed; as it is
    otherwise, or if it is broken."""
    try:
        from PIL import Image

        picture = Image.open(io.BytesIO(content)).convert("RGB")
        picture.thumbnail((LONGEST_SIDE, LONGEST_SIDE))
        out = io.BytesIO()
        picture.save(out, format="JPEG", quality=JPEG_QUALITY)
        content, media_type = out.getvalue(), "image/jpeg"
    except Exception:  # no library, or not an image that it knows
        pass
    return base64.b64encode(content).decode(), media_type


def vision(images: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """Findings in the first images of documents: key, vision_ok, vision_findings in order.  images: key, ord,
    location, media_type, width, height, content."""

    @F.pandas_udf("string")
    def ask(content: pd.Series, media_type: pd.Series, location: pd.Series) -> pd.Series:
        out = []
        for data, kind, where in zip(content, media_type, location, strict=True):  # one image at a time in memory
            packed, kind = prepare(bytes(data), kind)
            out += talk(model, "vision", [[{"role": "user", "image": packed, "media_type": kind, "text": f"An image of a document ({where})."}]])
        return pd.Series(out, dtype=object)

    first = spans.first_images(images.where("length(content) > 0"), key, MOST_IMAGES)
    replies = first.select(key, "ord", "location", F.from_json(ask.asNondeterministic()("content", "media_type", "location"), REPLY).alias("r"))
    rows = replies.select(key, F.col("r.ok").alias("ok"), F.struct("ord", flagged(F.col("r"), F.col("location"), "embedded_image").alias("f")).alias("f"))
    return rows.groupBy(key).agg(F.bool_and("ok").alias("vision_ok"), F.flatten(F.transform(F.sort_array(F.collect_list("f")), lambda x: x.f)).alias("vision_findings"))


def layer(extracted: DataFrame, model: Model | None, images: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """key, semantic_findings, ai_cleared and the columns of report.SEMANTIC_DEFAULTS for each document: its type,
    the analysis of at most ROUNDS rounds, a review that may dismiss findings, images, and a narrative if something
    was found.  Without a model nothing has run and nothing is cleared."""
    nothing = F.array().cast(f"array<{schemas.FINDING}>")
    if model is None:
        blank = {n: F.lit("") for n in ("document_description", "risk_narrative", "attack_scenario", "attack_sophistication", "semantic_model")}
        none = F.array().cast("array<string>")
        return extracted.select(key).withColumns({"semantic_findings": nothing, "ai_cleared": F.lit(False), "semantic_layer_ran": F.lit(False), "document_type": F.lit("unknown"), "remediation": none, "semantic_passes": none} | blank)
    c = F.col
    df = extracted
    if images is not None:
        df = df.join(vision(images, model, key), key, "left")
    else:
        df = df.withColumns({"vision_ok": F.lit(None).cast("boolean"), "vision_findings": nothing})
    one = lambda name, field, default="": _field(F.get(c(name), 0), field, default)
    hints = semantic.metadata_hints()
    begin = F.concat(F.when(hints != "", F.concat(F.lit("Metadata:\n"), hints, F.lit("\n"))).otherwise(""), F.lit("Visible text, its beginning:\n"), T.truncate(c("visible_text"), CLASSIFIED))
    df = df.withColumn("__r", asked(model, "classify", begin)).withColumn("__c", _calls(c("__r"), "type"))
    df = df.withColumns({"document_type": one("__c", "document_type", "unknown"), "document_description": one("__c", "description"), "__expected": one("__c", "expected_content")})
    kind = c("document_type")
    df = df.withColumn("__r", asked(model, "analyse", semantic.analysis_prompt(kind, semantic.type_hint(kind), c("__expected")), ROUNDS))
    df = df.withColumn("__f", flagged(c("__r"))).withColumn("__ok", c("__r.ok"))
    about = F.concat(F.lit("Document type: "), kind, F.lit("\n"), c("document_description"), F.lit("\n"), c("__expected"), F.lit("\n"), shown(c("__f")))
    df = df.withColumn("__r", asked(model, "review", F.when(F.size("__f") > 0, about))).withColumn("__reviewed", c("__r").isNotNull())
    gone = F.array_compact(F.transform(_calls(c("__r"), "dismiss"), lambda x: _field(x, "index").try_cast("int")))
    df = df.withColumn("__gone", gone).withColumn("__kept", F.filter("__f", lambda f, i: ~F.array_contains("__gone", i)))
    df = df.withColumn("semantic_findings", F.concat("__kept", F.coalesce("vision_findings", nothing)))
    found = F.size("semantic_findings") > 0
    story = F.concat(F.lit("Document type: "), kind, F.lit("\nFindings:\n"), shown(c("semantic_findings"), SHOWN["narrate"]))
    df = df.withColumn("__r", asked(model, "narrate", F.when(found, story))).withColumn("__n", _calls(c("__r"), "risk"))
    passes = [F.lit("classification"), F.lit("injection_analysis"), F.when(c("__reviewed"), "fp_review"), F.when(c("vision_ok").isNotNull(), "vision_analysis"), F.when(found, "risk_narrative")]
    return df.select(
        key, "semantic_findings", (c("__ok") & F.coalesce("vision_ok", F.lit(True)) & ~found).alias("ai_cleared"), F.lit(True).alias("semantic_layer_ran"), F.lit(model.name).alias("semantic_model"),
        "document_type", "document_description", *(one("__n", n).alias(n) for n in ("risk_narrative", "attack_scenario", "attack_sophistication")),
        T.coerce_list(one("__n", "remediation")).alias("remediation"), F.array_compact(F.array(*passes)).alias("semantic_passes"),
    )


def findings(layer: DataFrame, key: str = "doc_id") -> DataFrame:
    """The findings of a written layer as rows: key, ord, FIELDS."""
    return layer.select(key, F.posexplode("semantic_findings").alias("ord", "f")).select(key, "ord", "f.*")


def rewrite(reports: DataFrame, model: Model | None) -> DataFrame:
    """Reports with semantic findings, their sanitized text rewritten: the model sees its first REWRITTEN
    characters; what follows stays as it is.  A rewrite that loses a marker, an empty one and a failed one change
    nothing."""
    if model is None:
        return reports
    c = F.col
    own = F.filter("findings", lambda f: f.layer == "semantic")
    text = c("sanitized_text")
    prompt = F.concat(F.lit("Findings:\n"), shown(own, SHOWN["rewrite"], 150), F.lit("\nReplace each of them, and what means the same, by " + T.MARKER + ":\n"), T.left(text, REWRITTEN))
    df = reports.withColumn("__r", asked(model, "rewrite", F.when((F.size(own) > 0) & (text != ""), prompt)))
    df = df.withColumn("__new", T.strip(_field(F.get(_calls(c("__r"), "text"), 0), "text")))
    more = T.replacement_count(c("__new")) - T.replacement_count(T.left(text, REWRITTEN))
    good = c("__r.ok") & (c("__new") != "") & (more >= 0)
    note = F.when(c("__r").isNull(), None).when(~c("__r.ok"), FAILED_REWRITE).when(~good, EMPTY_REWRITE).when(more > 0, F.format_string(MORE_REMOVED, more))
    passes = F.when(c("__r").isNotNull(), F.concat("semantic_passes", F.array(F.lit("sanitization")))).otherwise(c("semantic_passes"))
    rest = F.substring(text, F.lit(REWRITTEN + 1), F.char_length(text))
    return df.withColumns({
        "sanitized_text": F.when(good, F.concat("__new", rest)).otherwise(text), "sanitization_changes": F.concat("sanitization_changes", F.array_compact(F.array(note))), "semantic_passes": passes,
    }).drop("__r", "__new")
