"""Column expressions that render prompts, images and reports."""
from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Text around question, context and history in an answer prompt.
ANSWER_TEMPLATE = """
    Question: {question}

    <context>
    {context}
    </context>
    
    Here is the current chat history - use if relevant:
    <chat_history>
    {chat_history}
    </chat_history>
    """


def render(template: str, **cols: Column) -> Column:
    """Fill ``{name}`` places of a literal template. Braces inside values stay as they are."""
    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2:
            parts.append(F.coalesce(cols[piece].cast("string"), F.lit("")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def data_uri(content: Column, mime: Column) -> Column:
    """Binary content as a base64 data URI on one line."""
    body = F.regexp_replace(F.base64(content), r"[\r\n]", "")
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), body)


def image_parts(files: Column) -> Column:
    """The image entries of an array of ``struct<mime, ...>``; null when there is none."""
    images = F.filter(files, lambda f: f["mime"].startswith("image"))
    return F.when(F.size(images) > 0, images)


def prompt_messages(system: Column, user: Column, image_urls: Column | None = None) -> Column:
    """JSON text of the system and the user message; image parts follow the user's text."""
    part = "struct<type:string,text:string,image_url:struct<url:string>>"
    no_image = F.lit(None).cast("struct<url:string>")
    parts = F.array(F.struct(F.lit("text").alias("type"), user.alias("text"), no_image.alias("image_url")).cast(part))
    if image_urls is not None:
        pictures = F.transform(image_urls, lambda u: F.struct(
            F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"),
            F.struct(u.alias("url")).alias("image_url")).cast(part))
        parts = F.concat(parts, F.coalesce(pictures, F.array().cast(f"array<{part}>")))
    messages = [F.to_json(F.struct(F.lit("system").alias("role"), system.alias("content"))),
                F.to_json(F.struct(F.lit("user").alias("role"), parts.alias("content")))]
    return F.concat(F.lit("["), messages[0], F.lit(","), messages[1], F.lit("]"))


def to_report_json(**fields: Column) -> Column:
    """A nested summary as JSON; missing values are written as null."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})


def json_field(c: Column, path: str, default: Column | None = None) -> Column:
    """A nested field of a JSON payload (``a.b.c``); absent gives null or ``default``."""
    value = F.get_json_object(c, "$." + path)
    return value if default is None else F.coalesce(value, default)
