"""Every place of a document that holds text, as one ordered list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwarden.functions.plan import exploded
from inkwarden.plans.rules import SKIPPED_METADATA

VISIBLE_METHODS = ("ocr_only",)


def _surface(kind: str, location: Column, content: Column, visible: Column | bool = False) -> Column:
    visible = F.lit(visible) if isinstance(visible, bool) else visible
    return F.struct(F.lit(kind).alias("kind"), location.alias("location"), content.alias("content"), visible.alias("is_visible"))


def surface_array() -> Column:
    """array<struct<kind,location,content,is_visible>> over the columns of schemas.EXTRACTED, in scan order,
    with empty contents left out."""
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    parts = [
        F.array(_surface("visible", F.lit("visible"), F.col("visible_text"), True)),
        F.transform("hidden_text", lambda h, i: _surface("hidden", F.coalesce(h.location, text("hidden_", i)), h.content, h.method.isin(*VISIBLE_METHODS))),
        F.transform("ocg_hidden_text", lambda h: _surface("ocg", text("ocg_layer:", h.layer_name), h.content)),
        F.transform("actual_text_spans", lambda h: _surface("actual_text", text("actual_text:page", h.page), h.extracted)),
        F.transform("clipped_text", lambda h: _surface("clipped", text("clipped:page", h.page), h.content)),
        F.transform("transparent_text", lambda h: _surface("transparent", text("transparent:page", h.page), h.content)),
        F.transform("tracked_changes", lambda h: _surface("tracked_change", text("tracked_change:", h.type), h.content)),
        F.transform("field_codes", lambda h, i: _surface("field_code", text("field_code:", i), h.instruction)),
        F.transform(F.filter("metadata", lambda m: ~m.key.isin(*SKIPPED_METADATA)), lambda m: _surface("metadata", text("metadata:", m.key), m.value)),
        F.transform("annotations", lambda a, i: _surface("annotation", text("annotation:", i), a)),
        F.transform("form_field_defaults", lambda m: _surface("form_field", text("form_field:", m.key), m.value)),
        F.transform("unicode_anomalies", lambda a: _surface("bidi_logical", F.lit("bidi_logical"), F.coalesce(a.logical_text, F.lit("")))),
    ]
    return F.filter(F.concat(*parts), lambda s: F.coalesce(s.content != "", F.lit(False)))


def surfaces(extracted: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per surface: key, surface_ord, kind, location, content, is_visible."""
    return exploded(extracted, surface_array(), "surface_ord", "s").select(key, "surface_ord", "s.*")
