"""Image records: admission, figures, placement, text below, colours, deduplication, names, pixel statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partmill.functions.scalars import is_bike_file, padded, recode, squeeze, strip, text

# Colour words, words of parts, words that no colour code is.
COLORS = "BLACK BLUE GREY GRAY CYAN RED WHITE SILVER YELLOW GREEN ORANGE GOLD BRONZE COPPER PURPLE VIOLET BROWN TITANIUM GRAPHITE CHARCOAL MAROON MAT MATT METALLIC COCKTAIL DARK LIGHT DEEP RACING PURPLISH VIVID PASTEL SOLID ICE FLUO PEARL CHROME SATIN MIDNIGHT STEALTH MONSTER CANDY GLOSS GLOSSY SHINY BRIGHT".split()
PARTS = "ASSY COMP FLANGE BOLT GASKET COVER WASHER NUT SCREW LEVER CABLE HEAD ENGINE BODY FRAME PLATE ROD SEAT TANK WHEEL PIPE HOSE PIN CLAMP SPRING BEARING SEAL O-RING COLLAR PLUG BRACKET TUBE".split()
NO_CODE = "COLOR COLOUR NAME CODE PAGE FIG".split()


def filter_images(images: DataFrame, page: int | None = None, term: str = "", category: str = "", model: str = "") -> DataFrame:
    """By page, by term in the file name or `page n`, by category (bikes, parts), by model where models are given."""
    own = images
    if page is not None:
        own = own.filter(F.col("page") == page)
    if term:
        t = term.lower()
        own = own.filter(F.lower("filename").contains(t) | F.concat(F.lit("page "), F.col("page").cast("string")).contains(t))
    if category:
        own = own.filter(is_bike_file("filename") if category == "bikes" else ~is_bike_file("filename"))
    if model and "models" in images.columns:
        own = own.filter(F.col("models").isNull() | F.array_contains("models", model))
    return own


def with_figure(images: DataFrame, page_figures: DataFrame) -> DataFrame:
    """fig_no and fig_name of the page; null on pages without a figure."""
    return images.join(page_figures.select("doc_id", "page", "fig_no", "fig_name"), ["doc_id", "page"], "left")


def admit_images(images: DataFrame, page_figures: DataFrame, parts_only: bool = False, least: int = 150) -> DataFrame:
    """On figure pages max >= 100 and min >= 40; elsewhere both sides over 150 when figures are known, else over 10, and with parts_only none but bike files."""
    own = with_figure(images, page_figures)
    big, small = F.greatest("width", "height"), F.least("width", "height")
    figures = page_figures.select("doc_id").distinct().withColumn("__known", F.lit(True))
    own = own.join(figures, "doc_id", "left")
    ok = F.when(F.col("fig_no").isNotNull(), (big >= 100) & (small >= 40)).when(F.col("__known"), small >= least).otherwise(small >= 10)
    if parts_only:
        ok = ok & (F.col("fig_no").isNotNull() | is_bike_file("filename"))
    return own.filter(ok).drop("__known")


def figures_or_all(images: DataFrame, page_figures: DataFrame) -> DataFrame:
    """Images on figure pages; all of a document's where none is."""
    own = with_figure(images, page_figures)
    hits = F.count("fig_no").over(Window.partitionBy("doc_id"))
    return own.withColumn("__hits", hits).filter((F.col("__hits") == 0) | F.col("fig_no").isNotNull()).drop("__hits")


def exclude_masks(images: DataFrame, masks: DataFrame) -> DataFrame:
    return images.join(masks.select("doc_id", "page", "filename").distinct(), ["doc_id", "page", "filename"], "left_anti")


EXTENSION = r"(?i)\.(?:png|jpe?g|jp2|webp|bmp|tiff?)$"


def match_placement(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Each image with the box of its name on the page, else of its size, else of its ordinal. Names are compared without extensions of images.

    images: doc_id, page, image_id, filename, width, height; an image_id is unique in its document.
    """
    keys = ["doc_id", "page"]
    bare = lambda c: F.regexp_replace(text(c), EXTENSION, "")
    ordinal = F.row_number().over(Window.partitionBy(*keys).orderBy("image_id"))
    own = images.withColumn("__n", ordinal).withColumn("__bare", bare("filename"))
    box = boxes.select(*keys, bare("name").alias("__name"), F.col("width").alias("__w"), F.col("height").alias("__h"), F.col("ordinal").alias("__o"), F.struct("x0", "top", "x1", "bottom").alias("__box"))
    # Each rule keeps the first box of a value: an image meets one box a rule, not all boxes of its page.
    rules = ({"__name": "__bare"}, {"__w": "width", "__h": "height"}, {"__o": "__n"})
    for k, at in enumerate(rules, 1):
        found = box.filter("__name <> ''") if k == 1 else box
        found = found.groupBy(*keys, *at).agg(F.min_by("__box", F.struct("__o")).alias(f"__box{k}")).alias("b")
        same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in keys] + [F.col(f"a.{v}") == F.col(f"b.{c}") for c, v in at.items()]
        own = own.alias("a").join(found, same, "left").select("a.*", f"b.__box{k}")
    got = [F.when(F.col(f"__box{k}").isNotNull(), F.struct(F.col(f"__box{k}").alias("box"), F.lit(k).alias("rule"))) for k in (1, 2, 3)]
    own = own.withColumn("__m", F.when(F.col("image_id").isNotNull(), F.coalesce(*got)))
    return own.select("doc_id", "image_id", *[c for c in images.columns if c not in ("doc_id", "image_id")], "__m.box", "__m.rule")


def text_below(images: DataFrame, words: DataFrame, margin: float = 150, tol: float = 50) -> DataFrame:
    """image_id, lines: words from 8 above the image's bottom to margin below, within tol of its sides, in lines of four points."""
    box = images.select("image_id", "doc_id", "page", F.col("x0").alias("__l"), F.col("x1").alias("__r"), F.col("bottom").alias("__b"))
    near = words.join(box, ["doc_id", "page"]).filter("top between __b - 8 and __b + %r and x1 >= __l - %r and x0 <= __r + %r" % (margin, tol, tol))
    lines = near.groupBy("image_id", F.rint(F.col("top") / 4).alias("y")).agg(F.sort_array(F.collect_list(F.struct("x0", "text"))).alias("w"))
    lines = lines.select("image_id", "y", F.array_join("w.text", " ").alias("line"))
    return lines.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("y", "line"))).alias("l")).select("image_id", F.col("l.line").alias("lines"))


def match_color(images: DataFrame, colors: DataFrame) -> DataFrame:
    """The document's first colour entry whose name holds BLACK for black images, else the hue; colors(doc_id, entry_order, color_name, color_code)."""
    wanted = F.when(F.col("is_black"), "BLACK").otherwise(F.upper("hue"))
    pairs = images.withColumn("__hue", wanted).join(colors, "doc_id").filter(F.upper("color_name").contains(F.col("__hue")))
    best = pairs.groupBy("image_id").agg(F.min_by(F.struct("color_name", "color_code"), "entry_order").alias("c"))
    return images.join(best.select("image_id", "c.color_name", "c.color_code"), "image_id", "left")


def selected_images(images: DataFrame, selection: DataFrame) -> DataFrame:
    """Images chosen by id or file name; all of a document's where nothing matches. selection(doc_id, pick)."""
    picks = selection.select("doc_id", F.col("pick").alias("__pick")).distinct()
    by_id = images.withColumn("__pick", F.col("image_id").cast("string")).join(picks, ["doc_id", "__pick"], "left_semi")
    by_name = images.withColumn("__pick", F.col("filename")).join(picks, ["doc_id", "__pick"], "left_semi")
    hit = by_id.unionByName(by_name).select("doc_id", "image_id").distinct().withColumn("__hit", F.lit(1))
    own = images.join(hit, ["doc_id", "image_id"], "left").withColumn("__any", F.max("__hit").over(Window.partitionBy("doc_id")))
    return own.filter("__hit = 1 or __any is null").select(*images.columns)


def images_by_model(images: DataFrame, models: DataFrame) -> DataFrame:
    """Each image under each model of its document, the file name re-coded; models(doc_id, model)."""
    return images.join(models.select("doc_id", "model").distinct(), "doc_id").withColumn("filename", recode("filename", "model"))


def dedupe_images(images: DataFrame) -> DataFrame:
    """The first of equal payloads of a document, in page order."""
    same = Window.partitionBy("doc_id", "sha256").orderBy("page", "image_id")
    own = images.withColumn("sha256", F.sha2("payload", 256)).withColumn("__n", F.row_number().over(same))
    return own.filter("__n = 1").drop("__n")


def unique_names(df: DataFrame, keys: list[str], name: str, order: list[str], start: int = 2, fold: bool = False) -> DataFrame:
    """`name` with _2, _3, ... on repeats within `keys`, in `order`; start=1 numbers the first repeat 1.

    A suffixed name that another row already has by itself is numbered on past
    the highest number which the base has anywhere in the group.
    """
    key = F.lower(name) if fold else F.col(name)
    same = Window.partitionBy(*keys, "__key")
    own = df.withColumn("__key", key).withColumn("__k", F.row_number().over(same.orderBy(*order)))
    taken = own.select(*keys, "__key").distinct()
    base = F.regexp_extract("__key", r"^(.*)_([0-9]{1,9})$", 1)
    numbers = taken.withColumn("__base", base).filter("__base <> ''").groupBy(*keys, F.col("__base").alias("__key")).agg(F.max(F.regexp_extract("__key", r"_([0-9]{1,9})$", 1).cast("bigint")).alias("__high"))
    own = own.join(numbers, [*keys, "__key"], "left")
    n = F.col("__k") - 2 + start + F.when(F.col("__high") >= start, F.col("__high") - start + 1).otherwise(0)
    return own.withColumn(name, F.when(F.col("__k") == 1, F.col(name)).otherwise(F.concat(name, F.lit("_"), n.cast("string")))).select(*df.columns)


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(c, pattern, group)


def _words(c: Column) -> Column:
    return F.filter(F.split(F.upper(c), "[^A-Z0-9]+"), lambda w: w != "")


def _has(words: Column, known: list[str]) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in known]))


def color_info(lines) -> Column:
    """is_bike_color, color_name, color_code from the lines below an image (array of strings)."""
    lines = F.coalesce(F.col(lines) if isinstance(lines, str) else lines, F.array().cast("array<string>"))
    whole = strip(F.array_join(lines, " "))
    words = _words(whole)
    colored, parts = F.coalesce(_has(words, COLORS), F.lit(False)), F.coalesce(_has(words, PARTS), F.lit(False))
    named = strip(_first(whole, r"(?i)(?:COLOU?R\s+NAME|COLOU?R)\s*[:\-]\s*([A-Za-z0-9\s&]+?)(?=\s*(?:COLOU?R\s+CODE|CODE|\(|$))"))
    labelled = squeeze(F.regexp_replace(_first(whole, r"(?i)(?:COLOU?R\s+CODE|CODE|COLOU?R\s+NO\.?)\s*[:\-]\s*([A-Za-z0-9/()\s]+)"), "[^A-Za-z0-9/]", " "))
    paren = strip(_first(whole, r"\(\s*([A-Z0-9]{3,8}(?:\s*/\s*[A-Z0-9]{3,8})?)\s*\)"))
    number = _first(whole, r"\b([0-9]{4})\b")
    code = F.when(labelled != "", labelled).otherwise(paren)
    code = F.when(number == "", code).when(code == "", number).when(~code.contains(number), F.concat(code, F.lit("_"), number)).otherwise(code)

    def cleaned(line: Column) -> Column:
        own = F.regexp_replace(line, r"(?i)^(?:COLOU?R\s+NAME|COLOU?R|CODE)\s*[:\-]\s*", "")
        own = F.regexp_replace(F.regexp_replace(own, r"\([^)]*\)", ""), r"\b[0-9]{4}\b", "")
        return squeeze(F.regexp_replace(own, r"[:\-/,]", " "))

    from_lines = F.filter(F.transform(F.filter(lines, lambda x: F.coalesce(_has(_words(x), COLORS), F.lit(False))), cleaned), lambda x: x != "")
    name = F.when((named == "") & colored, F.coalesce(F.try_element_at(from_lines, F.lit(1)), F.lit(""))).otherwise(named)
    said = F.upper(whole).rlike("COLOU?R")
    stop = F.array(*[F.lit(w) for w in [*COLORS, *PARTS, *NO_CODE]])
    tokens = F.filter(F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(r"\b([A-Z][A-Z0-9]{2,5})\b"), F.lit(1)))), lambda t: ~F.array_contains(stop, t))
    code = F.when((code == "") & (colored | said), F.coalesce(F.try_element_at(tokens, F.lit(1)), F.lit(""))).otherwise(code)
    name = F.upper(squeeze(F.regexp_replace(name, r'[/:*?"<>|\r\n\t]', " ")))
    code = F.upper(F.regexp_replace(F.regexp_replace(code, "[^A-Za-z0-9_]", "_"), "^_+|_+$", ""))
    bike = (((name != "") | (code != "")) & colored) | said
    return F.struct((bike & ~(parts & ~colored)).alias("is_bike_color"), name.alias("color_name"), code.alias("color_code"))


def is_color_chart(c) -> Column:
    return text(c).rlike(r"(?i)\b(?:COLOU?R\s+CODE|APPLICABLE\s+COLOU?R)\b")


def color_entries(pages: DataFrame) -> DataFrame:
    """doc_id, entry_order, abbrev, color_name, color_code from the text of pages 1 to 6."""
    lines = pages.filter(F.col("page").between(1, 6) & is_color_chart("text")).select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    pattern = r"\b([A-Z0-9]{2,6})\s*(?:\(\*\))?\s+([A-Za-z0-9\s]+?)\s+([0-9]{4})\b"
    got = lines.select("doc_id", "page", "pos", *[_first(F.col("line"), pattern, k).alias(n) for k, n in ((1, "abbrev"), (2, "color_name"), (3, "color_code"))])
    got = got.filter("abbrev <> ''").withColumn("color_name", strip("color_name")).filter(_has(_words(F.col("color_name")), COLORS))
    return got.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "pos")).alias("entry_order"), "abbrev", "color_name", "color_code")


def bike_decision(images: DataFrame, colors: DataFrame, with_bikes: bool = True) -> DataFrame:
    """is_bike, color_name and color_code of each image.

    images: doc_id, image_id, page, width, height, fig_no, chart (the page is a
    colour chart), binary, info (color_info of the lines below), is_colored,
    is_black and hue (pixel_stats). Images on figure pages and binary ones are no
    bikes. A colour in the text below decides; else, on pages 1 to 3 and colour
    charts, images of 120 x 80 or more that are coloured or black, with the
    document's first entry whose name holds BLACK or the hue; a black one without
    an entry is MAT BLACK. colors: doc_id, entry_order, color_name, color_code.
    """
    sound = F.col("fig_no").isNull() & ~F.coalesce("binary", F.lit(False)) & F.lit(with_bikes)
    said = sound & F.coalesce(F.col("info.is_bike_color"), F.lit(False))
    early = (F.col("page") <= 3) | F.coalesce("chart", F.lit(False))
    black, colored = F.coalesce("is_black", F.lit(False)), F.coalesce("is_colored", F.lit(False))
    seen = sound & ~said & early & (F.col("width") >= 120) & (F.col("height") >= 80) & (black | colored)
    own = images.withColumn("__said", said).withColumn("__seen", seen)
    own = own.withColumn("__word", F.when(seen, F.when(black, "BLACK").otherwise(F.nullif(text("hue"), F.lit("")))))
    entry = colors.select("doc_id", "entry_order", F.col("color_name").alias("__n"), F.col("color_code").alias("__c"))
    hits = own.filter("__word is not null").select("doc_id", "image_id", "__word").join(entry, "doc_id").filter(F.upper("__n").contains(F.col("__word")))
    first = hits.groupBy("doc_id", "image_id").agg(F.min_by(F.struct("__n", "__c"), "entry_order").alias("__hit"))
    own = own.join(first, ["doc_id", "image_id"], "left")
    name = F.when(F.col("__said"), text("info.color_name")).when(F.col("__hit").isNotNull(), F.col("__hit.__n")).when(F.col("__seen") & black, "MAT BLACK").otherwise("")
    code = F.when(F.col("__said"), text("info.color_code")).when(F.col("__hit").isNotNull(), text("__hit.__c")).otherwise("")
    return own.withColumn("color_name", name).withColumn("color_code", code).withColumn("is_bike", F.col("__said") | F.col("__seen")).select(*[c for c in images.columns if c not in ("color_name", "color_code", "is_bike")], "is_bike", "color_name", "color_code")


def image_names(images: DataFrame, model: str = "model") -> DataFrame:
    """filename, and fig_no and fig_name of bikes; names of a document that meet are numbered in page order.

    Figures YAM_{model}_{figure}, where characters that no file name holds are
    spaces and a figure without a name is FIG_nn; bikes
    YAM_{model}_BIKE[_code][_name], the code left out where the name holds it;
    others YAM_{model}_PAGE_p_IMG_i. Bikes without colour are numbered among all
    bikes. images: doc_id, image_id, page, model, fig_no, fig_name, is_bike,
    color_name, color_code.
    """
    safe = lambda c: squeeze(F.regexp_replace(text(c), r'[/:*?"<>|\r\n\t]', " "))
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.upper(text(c)), "[^A-Z0-9]+", "_"), "^_+|_+$", "")
    lead = F.concat(F.lit("YAM_"), F.col(model), F.lit("_"))
    number = padded("fig_no")
    spare = F.when(number != "", F.concat(F.lit("FIG_"), number)).otherwise(F.concat(F.lit("PAGE_"), F.col("page").cast("string")))
    figure = F.when(safe("fig_name") != "", safe("fig_name")).otherwise(spare)
    name, code = plain("color_name"), plain("color_code")
    parts = [F.when(x == "", "").otherwise(F.concat(F.lit("_"), x)) for x in (F.when(name.contains(code), "").otherwise(code), name)]
    in_order = Window.partitionBy("doc_id").orderBy("page", "image_id")
    own = images.withColumn("__nth", F.sum(F.col("is_bike").cast("int")).over(in_order))
    own = own.withColumn("__i", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("image_id")))
    nth = F.when((name == "") & (code == "") & (F.col("__nth") > 1), F.concat(F.lit("_"), F.col("__nth").cast("string"))).otherwise("")
    other = F.concat(F.lit("PAGE_"), F.col("page").cast("string"), F.lit("_IMG_"), F.col("__i").cast("string"))
    kind = F.when(F.col("is_bike"), "bike").when(F.col("fig_no").isNotNull(), F.concat(F.lit("figure "), strip("fig_no"))).otherwise("other")
    own = own.withColumn("filename", F.concat(lead, F.when(F.col("is_bike"), F.concat(F.lit("BIKE"), *parts, nth)).when(F.col("fig_no").isNotNull(), figure).otherwise(other)))
    same = Window.partitionBy("doc_id", "__kind", "filename").orderBy("page", "image_id")
    own = own.withColumn("__kind", kind).withColumn("__k", F.row_number().over(same))
    own = own.withColumn("filename", F.when(F.col("__k") == 1, F.col("filename")).otherwise(F.concat("filename", F.lit("_"), F.col("__k").cast("string"))))
    color, of = text("color_name"), text("color_code")
    both = F.when((color != "") & (of != ""), F.concat(color, F.lit(" ("), of, F.lit(")"))).when(color != "", color).when(of != "", F.concat(F.lit("BIKE "), of)).otherwise("BIKE PHOTO")
    own = own.withColumn("fig_no", F.when(F.col("is_bike"), "BIKE").otherwise(F.col("fig_no"))).withColumn("fig_name", F.when(F.col("is_bike"), both).otherwise(F.col("fig_name")))
    return own.drop("__nth", "__i", "__kind", "__k")


def image_counts(images: DataFrame) -> DataFrame:
    return images.groupBy("doc_id").agg(F.count("*").alias("images"), F.count_if(is_bike_file("filename")).alias("bikes"), F.count_if(~is_bike_file("filename")).alias("parts"))


def image_pages(images: DataFrame) -> DataFrame:
    return images.select("doc_id", "page").distinct()


# The upper ends of the hues in degrees; RED goes on from 345.
HUES = [(15, "RED"), (45, "ORANGE"), (75, "YELLOW"), (165, "GREEN"), (205, "CYAN"), (265, "BLUE"), (345, "PURPLE")]


def hue_name(h: Column) -> Column:
    out = F.when(h < HUES[0][0], HUES[0][1])
    for end, name in HUES[1:]:
        out = out.when(h < end, name)
    return out.otherwise("RED")


def pixel_stats(pixels: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Colour statistics of each image from pixels(image_id, r, g, b): coloured, black vehicle, dominant hue, photographic.

    Coloured: saturation 18 of 255 on 2.5 % of all pixels. Black vehicle: of the
    pixels that aren't all 242 or more, under 5 % have saturation .18 and value
    .15, and 35 % a value up to .45. Hue: the mean over such coloured pixels of
    those that aren't all 240 or more, if they are 2 %. Photographic: 70 colours or
    more, mean deviation 18 or more, at most 88 % white, and not over 50 % black
    with over 25 % white; sizes(image_id, width, height), where given, must be
    120 x 80 or more with an aspect of 0.65 to 3.
    """
    top, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    span = (top - low).cast("double")
    own = pixels.withColumn("v", top / 255.0).withColumn("s", F.when(top == 0, 0.0).otherwise(span / top)).withColumn("d", span)
    hue = F.when(F.col("d") == 0, 0.0).when(F.col("r") == top, F.pmod((F.col("g") - F.col("b")) / F.col("d"), F.lit(6.0))).when(F.col("g") == top, (F.col("b") - F.col("r")) / F.col("d") + 2).otherwise((F.col("r") - F.col("g")) / F.col("d") + 4) * 60
    own = own.withColumn("h", hue).withColumn("s242", low < 242).withColumn("s240", low < 240).withColumn("vivid", (F.col("s") >= 0.18) & (F.col("v") >= 0.15))
    mean = F.avg(F.when(F.col("s240") & F.col("vivid"), F.col("h")))
    got = own.groupBy("image_id").agg(
        F.count("*").alias("n"), F.count_if(F.floor(F.col("s") * 255) >= 18).alias("n_colored"), F.count_if("s242").alias("n_242"), F.count_if("s240").alias("n_240"),
        F.count_if(F.col("s242") & F.col("vivid")).alias("n_vivid_242"), F.count_if(F.col("s242") & (F.col("v") <= 0.45)).alias("n_dark"),
        F.count_if(F.col("s240") & F.col("vivid")).alias("n_vivid_240"), F.round(mean, 6).alias("mean_hue"), F.count_distinct(F.struct("r", "g", "b")).alias("n_colors"),
        F.round((F.stddev_pop("r") + F.stddev_pop("g") + F.stddev_pop("b")) / 3, 6).alias("spread"), F.count_if(low >= 248).alias("n_white"), F.count_if(top <= 15).alias("n_black"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    white, black = share("n_white", "n"), share("n_black", "n")
    photo = (F.col("n_colors") >= 70) & (F.col("spread") >= 18) & (white <= 0.88) & ~((black > 0.5) & (white > 0.25))
    if sizes is not None:
        got = got.join(sizes.select("image_id", "width", "height"), "image_id", "left")
        aspect = F.col("width") / F.col("height")
        photo = photo & F.coalesce((F.col("width") >= 120) & (F.col("height") >= 80) & (aspect >= 0.65) & (aspect <= 3.0), F.lit(False))
    return got.select(
        "image_id", "n", "n_colors", "spread", "mean_hue", (share("n_colored", "n") >= 0.025).alias("is_colored"),
        ((F.col("n_242") > 0) & (share("n_vivid_242", "n_242") < 0.05) & (share("n_dark", "n_242") >= 0.35)).alias("is_black"),
        F.when(share("n_vivid_240", "n_240") >= 0.02, hue_name(F.col("mean_hue"))).otherwise("").alias("hue"), photo.alias("is_photo"),
    )
