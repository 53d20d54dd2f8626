"""Decoders of enumerations, colours, configurations and payloads, each with its default."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The enumerations of the data model and the extensions of image files.
FILE_TYPES, IMAGE_EXTENSIONS = ["pdf", "image"], ["png", "jpg", "jpeg", "webp", "bmp", "gif", "tiff", "tif"]
VIEW_MODES = ["single", "double_page", "single_scroll", "double_scroll"]
TEXT_KINDS = ["highlight", "underline", "strikethrough", "note"]
MARK_KINDS = ["brush", "shape", "sticky", "stamp"]
ACTIONS = ["translate", "explain", "search", "chat", "vision"]
ROLES = ["user", "assistant", "system"]
# The fields of a stored configuration with what they are where nothing is set, and its lists and maps.
CONFIG_DEFAULTS = {
    "base_url": "", "api_key": "", "text_model": "", "vision_model": "", "vision_base_url": None, "vision_api_key": None, "search_use_builtin": False, "search_base_url": None,
    "search_api_key": None, "translate_target_lang": "中文", "web_search_enabled": False, "ocr_mode": "high_precision", "include_book_history": True, "enable_reasoning": False,
    "reasoning_effort": "medium", "temperature": 0.7, "prompt_template": "general", "custom_prompt": "",
}
CONFIG_LISTS = {"custom_prompts": "array<struct<name:string,text:string>>", "template_overrides": "map<string,string>"}
STYLE = "strokeWidth double, color string, fill boolean, fontSize double"


def one_of(value: Column, known: list[str], default: str | None) -> Column:
    return F.when(value.isin(known), value).otherwise(F.lit(default))


def tidy(value: Column) -> Column:
    return F.lower(F.trim(value))


def file_type(value: Column) -> Column:
    return one_of(value, FILE_TYPES, "image")


def view_mode(value: Column) -> Column:
    """Either spelling: double_scroll or doubleScroll."""
    snake = F.lower(F.regexp_replace(value, "([a-z])([A-Z])", "$1_$2"))
    return one_of(snake, VIEW_MODES, "single")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def type_of_path(path: Column) -> Column:
    """pdf, image, or null for a file that can't be imported."""
    return F.when(extension(path) == "pdf", "pdf").when(extension(path).isin(IMAGE_EXTENSIONS), "image")


def stem(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.coalesce(F.nullif(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.lit("")), F.lit("untitled"))


def colour(value: Column) -> Column:
    """#RRGGBB as a number, null if it is none."""
    return F.when(value.rlike("^#[0-9A-Fa-f]{6}$"), F.conv(F.substring(value, 2, 6), 16, 10).cast("long"))


def colour_text(value: Column) -> Column:
    return F.concat(F.lit("#"), F.lpad(F.lower(F.hex(value)), 6, "0"))


def payload_text(payload: Column, key: str) -> Column:
    """A field of a JSON payload if it is a string, else null; null for broken JSON."""
    field = F.variant_get(F.try_parse_json(payload), f"$.{key}", "variant")
    return F.when(F.schema_of_variant(field) == "STRING", F.try_variant_get(F.try_parse_json(payload), f"$.{key}", "string"))


def payload_points(payload: Column) -> Column:
    return F.coalesce(F.json_array_length(F.get_json_object(payload, "$.points")), F.lit(0))


def style(value: Column) -> Column:
    s = F.from_json(value, STYLE)
    return F.struct(
        F.coalesce(s["strokeWidth"], F.lit(3.0)).alias("stroke_width"), s["color"].alias("color"), F.coalesce(s["fill"], F.lit(False)).alias("fill"),
        F.coalesce(s["fontSize"], F.lit(14.0)).alias("font_size")
    )


def config(value: Column) -> Column:
    """A configuration's JSON with defaults for what is missing or broken; the temperature within [0, 2], the mode of recognition fast or high_precision."""
    kinds = {k: "boolean" if isinstance(v, bool) else "double" if isinstance(v, float) else "string" for k, v in CONFIG_DEFAULTS.items()} | CONFIG_LISTS
    s = F.from_json(value, ", ".join(f"{k} {t}" for k, t in kinds.items()))
    fields = {k: F.coalesce(s[k], F.lit(v)) if v is not None else s[k] for k, v in CONFIG_DEFAULTS.items()}
    fields["temperature"] = F.greatest(F.lit(0.0), F.least(F.lit(2.0), fields["temperature"]))
    fields["ocr_mode"] = F.when(fields["ocr_mode"] == "fast", "fast").otherwise("high_precision")
    empty = {"custom_prompts": F.array(), "template_overrides": F.create_map()}
    return F.struct(*(c.alias(k) for k, c in fields.items()), *(F.coalesce(s[k], empty[k].cast(t)).alias(k) for k, t in CONFIG_LISTS.items()))


def rects(value: Column) -> Column:
    return F.coalesce(F.from_json(value, "array<struct<x:double,y:double,w:double,h:double>>"), F.array().cast("array<struct<x:double,y:double,w:double,h:double>>"))
