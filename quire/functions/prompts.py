"""Prompts for pictures as Column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as T

# The lines of the prompts, where names in braces are filled in, and what stands where a style or a page says nothing.
SCENE = (
    "{art}",
    "Scene: {summary}",
    "Characters: {names}",
    "Composition: {camera}; one emotionally clear action; no visible text.",
    "Continuity: {rules}",
    "Avoid: {avoid}.",
)
PAGE = (
    "Use case: illustration-story",
    "Asset type: children's picture-book spread illustration for {product}",
    "Primary request: Create the illustration for spread {spread_id}.",
    "Scene/backdrop: {scene}",
    "Subject: {characters}",
    "Style/medium: {art}",
    "Composition/framing: {camera}; landscape 3:2 spread; leave calm negative space where a caption can be placed outside the image.",
    "Lighting/mood: gentle, emotionally clear, child-safe, warm, readable silhouettes.",
    "Color palette: {palette}.",
    "Text: no text inside the image.",
    "Constraints: keep recurring characters visually consistent; one clear action; no watermark; no logos; no visible typography; no scary violence.",
    "Avoid: {avoid}.",
    "",
    "Reader caption context, not to render as text:",
    '"{caption}"',
    "",
    "Source excerpt for grounding, not to render as text:",
    '"{excerpt}"',
    "",
    "Save/import target in {product}:",
    "{target}",
    "",
)
SHEET = (
    "Use case: illustration-story",
    "Asset type: character reference sheet for a children's picture-book generator",
    "Primary request: Create a clean character reference sheet for {name}.",
    "Subject: {description}",
    "Visual anchors: {anchors}",
    "Style/medium: {art}",
    "Composition/framing: one full-body front view, one side view, and three small expression heads on a simple warm paper background.",
    "Lighting/mood: gentle, child-safe, clear, readable.",
    "Color palette: {palette}.",
    "Text: no text, labels, captions, signatures, or watermark inside the image.",
    "Constraints: the sheet is only for visual consistency; keep the design simple enough to reuse across many story pages.",
    "Avoid: {avoid}.",
    "",
    "Save/import target in {product}:",
    "{target}",
    "",
)
CHARACTER = "{name}: {description} Visual anchors: {anchors}.{reference}"
HAS_REFERENCE = " Reference image already exists at {asset}."
HAS_PROMPT = " Character reference prompt: {prompt_path}."
ANYBODY = "people named or implied by the scene summary only; no unrelated recurring cast"
SOMEBODY = "the main story characters described by the scene"
PLAIN_ART = "warm illustrated picture-book art"
PLAIN_CAMERA = "clear storybook composition"
PLAIN_SCENE_ART = "gentle illustrated picture book, warm light, clear silhouettes"
PLAIN_SCENE_CAMERA = "storybook eye-level composition"
PLAIN_RULES = "Keep expressions child-safe and readable."
PLAIN_AVOID = "photorealistic, harsh horror, crowded tiny details, distorted hands, illegible text in image"
PAGE_PALETTE = "warm paper, teal, coral, gold, soft blue-green"
SHEET_PALETTE = "warm paper cream, deep teal, coral, gold, muted blue-green"


def filled(lines: tuple[str, ...] | str, **values: Column | str) -> Column:
    """The lines with a column or text for each name in braces."""
    whole = lines if isinstance(lines, str) else "\n".join(lines)
    parts = re.split(r"\{(\w+)\}", whole)
    word = lambda p: F.lit(p) if isinstance(p, str) else p
    return F.concat(*[word(values[p]) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def _or(c: Column | None, other: str) -> Column:
    return F.lit(other) if c is None else F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(other))


def scene_prompt(summary: Column, names: Column, art: Column | None = None, camera: Column | None = None, rules: Column | None = None, avoid: Column | None = None) -> Column:
    """Six lines on a scene. names: array of the characters seen; rules: array. What a style lacks is filled in."""
    seen = F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise(ANYBODY)
    kept = F.lit(PLAIN_RULES) if rules is None else F.when(F.size(rules) > 0, F.array_join(rules, " ")).otherwise(PLAIN_RULES)
    return filled(SCENE, art=_or(art, PLAIN_SCENE_ART), summary=T.text(summary), names=seen, camera=_or(camera, PLAIN_SCENE_CAMERA), rules=kept, avoid=_or(avoid, PLAIN_AVOID))


def character_line(name: Column, description: Column, anchors: Column, asset: Column, prompt_path: Column) -> Column:
    """What a page's prompt says of one character and where its reference is."""
    reference = F.when(T.text(asset) != "", filled(HAS_REFERENCE, asset=T.text(asset))).otherwise(filled(HAS_PROMPT, prompt_path=T.text(prompt_path)))
    return filled(CHARACTER, name=T.text(name), description=T.text(description), anchors=F.array_join(anchors, ", "), reference=reference)


def page_prompt(product: str, spread_id: Column, scene: Column, characters: Column, caption: Column, excerpt: Column, target: Column, art: Column | None = None, camera: Column | None = None, palette: Column | None = None, avoid: Column | None = None) -> Column:
    """The prompt of one page's picture. characters: array of ``character_line``; product: whose asset it is."""
    subject = F.when(F.size(characters) > 0, F.array_join(characters, "\n")).otherwise(SOMEBODY)
    grounds = F.coalesce(F.nullif(excerpt, F.lit("")), T.text(caption))
    style = {"art": _or(art, PLAIN_ART), "camera": _or(camera, PLAIN_CAMERA), "palette": _or(palette, PAGE_PALETTE), "avoid": _or(avoid, PLAIN_AVOID)}
    return filled(PAGE, product=product, spread_id=spread_id, scene=T.text(scene), characters=subject, caption=T.text(caption), excerpt=grounds, target=target, **style)


def sheet_prompt(product: str, name: Column, description: Column, anchors: Column, target: Column, art: Column | None = None, palette: Column | None = None, avoid: Column | None = None) -> Column:
    """The prompt of a character's reference sheet."""
    style = {"art": _or(art, PLAIN_ART), "palette": _or(palette, SHEET_PALETTE), "avoid": _or(avoid, PLAIN_AVOID)}
    return filled(SHEET, product=product, name=T.text(name), description=T.text(description), anchors=F.array_join(anchors, ", "), target=target, **style)
