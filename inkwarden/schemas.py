"""Schemas of the tables that operators exchange (DDL strings)."""

from __future__ import annotations

PAIR = "struct<key:string,value:string>"
ANOMALY = "struct<char:string,codepoint:string,category:string,location:string,count:int,logical_text:string,visual_text:string,examples:array<string>>"

#: Everything that an extractor knows of a document; no field is null.
EXTRACTED = {
    "visible_text": "string",
    "hidden_text": "array<struct<location:string,content:string,method:string>>",
    "metadata": f"array<{PAIR}>",
    "annotations": "array<string>",
    "form_field_defaults": f"array<{PAIR}>",
    "ocr_text": "string",
    "unicode_anomalies": f"array<{ANOMALY}>",
    "ocg_hidden_text": "array<struct<layer_name:string,content:string>>",
    "actual_text_spans": "array<struct<page:int,visual:string,extracted:string>>",
    "clipped_text": "array<struct<page:int,content:string>>",
    "transparent_text": "array<struct<page:int,content:string,alpha:double>>",
    "font_encoding_anomalies": "array<struct<page:int,font_name:string,note:string>>",
    "tracked_changes": "array<struct<type:string,content:string,author:string>>",
    "field_codes": "array<struct<instruction:string>>",
    "macro_present": "boolean",
}

FINDING = (
    "struct<layer:string,severity:string,category:string,description:string,evidence:string,"
    "location:string,confidence:double,reasoning:string,attack_vector:string>"
)


def completed(df):
    """df with every column of EXTRACTED: missing ones and nulls become empty."""
    from pyspark.sql import functions as F

    def empty(kind: str):
        return F.array().cast(kind) if kind.startswith("array") else F.lit("" if kind == "string" else False)

    have = {c.lower() for c in df.columns}
    return df.withColumns({n: F.coalesce(F.col(n).cast(k), empty(k)) if n in have else empty(k) for n, k in EXTRACTED.items()})
