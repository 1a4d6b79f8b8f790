"""Column expressions on boxes [x0, y0, x1, y1] in shares of a page, and on image sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Side of an image tile, tokens of a tile, and the side up to which an image is one tile.
TILE, TILE_TOKENS, SMALL = 768, 258, 384


def valid_box(box: Column) -> Column:
    x0, y0, x1, y1 = (box[i] for i in range(4))
    return F.coalesce((F.size(box) == 4) & (x0 >= 0) & (x0 < x1) & (x1 <= 1) & (y0 >= 0) & (y0 < y1) & (y1 <= 1), F.lit(False))


def to_pixels(box: Column, width: Column, height: Column) -> Column:
    """Rounded half to even."""
    return F.transform(box, lambda x, i: F.bround(x * F.when(i % 2 == 0, width).otherwise(height)).cast("int"))


def with_margin(box: Column, margin: float) -> Column:
    """Grown on each side by a share of its own width or height, cut at the page."""
    w, h = (box[2] - box[0]) * margin, (box[3] - box[1]) * margin
    return F.array(F.greatest(box[0] - w, F.lit(0.0)), F.greatest(box[1] - h, F.lit(0.0)), F.least(box[2] + w, F.lit(1.0)), F.least(box[3] + h, F.lit(1.0)))


def area_share(box: Column) -> Column:
    return (box[2] - box[0]) * (box[3] - box[1])


def area_warnings(box: Column) -> Column:
    share = area_share(box)
    touches = (box[0] <= 0) | (box[1] <= 0) | (box[2] >= 1) | (box[3] >= 1)
    return F.array_compact(F.array(F.when(share < 0.01, "very_small_crop"), F.when(share > 0.95, "nearly_full_page"), F.when(touches, "touches_boundary")))


def image_tokens(width: Column, height: Column) -> Column:
    tiles = F.ceil(width / TILE) * F.ceil(height / TILE) * TILE_TOKENS
    return F.when((width <= SMALL) & (height <= SMALL), F.lit(TILE_TOKENS)).otherwise(tiles).cast("long")


def to_shares(box: Column, width: Column, height: Column) -> Column:
    return F.transform(box, lambda x, i: x / F.when(i % 2 == 0, width).otherwise(height))


def clipped_pixels(box: Column, width: Column, height: Column) -> Column:
    """(box, clipped): pixels cut at the image, and whether that changed them."""
    own = F.array(F.greatest(box[0], F.lit(0)), F.greatest(box[1], F.lit(0)), F.least(box[2], width), F.least(box[3], height))
    return F.struct(own.alias("box"), (own != box).alias("clipped"))


def grown_pixels(box: Column, width: Column, height: Column, margin: float) -> Column:
    """As clipped_pixels(), of a box in shares grown on each side by a share of the image's width or height."""
    px = to_pixels(box, width, height)
    grown = F.transform(px, lambda x, i: (x + F.when(i < 2, -1).otherwise(1) * F.bround(F.when(i % 2 == 0, width).otherwise(height) * margin)).cast("int"))
    return clipped_pixels(grown, width.cast("int"), height.cast("int"))


#: Tokens of an image by resolution class, for models that count so.
TOKENS_BY_CLASS = {"unspecified": 1120, "low": 280, "medium": 560, "high": 1120, "ultra_high": 2240}
_CLASS_NAMES = {"": "unspecified", "default": "unspecified", "ultrahigh": "ultra_high", "ultra-high": "ultra_high"}


def resolution_class(c: Column) -> Column:
    """The class that a name means; null where it is none.  Null and blank are unspecified."""
    name = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    known = F.create_map(*[F.lit(x) for k, v in (_CLASS_NAMES | {k: k for k in TOKENS_BY_CLASS}).items() for x in (k, v)])
    return known[name]


def model_image_tokens(width: Column, height: Column, by_class: Column, resolution: Column) -> Column:
    """Tokens of an image: by its class where the model counts so, else by tiles; null for an unknown class."""
    table = F.create_map(*[F.lit(x) for k, v in TOKENS_BY_CLASS.items() for x in (k, v)])
    name = resolution_class(resolution)
    return F.when(name.isNotNull(), F.when(by_class, table[name].cast("long")).otherwise(image_tokens(width, height)))
