"""Column -> Column rules for part numbers, texts, names, codes, money and image sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dashes U+2010 to U+2015, quantities that mean none, names of the custom sections, words in file names that are no codes.
DASHES = "\\x{2010}-\\x{2015}"
WHITE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))  # (?U)\s
NO_QUANTITY = ["", "-", "none", "null", "0", "*"]
SECTIONS = ["PART KITS & SETS", "REGULAR SERVICE PARTS"]
NO_FILE_CODE = ["PART", "PAGE", "BOOK", "EDIT", "FILE", "LIST", "TEMP"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text(c) -> Column:
    """The column, null as ''."""
    return F.coalesce(_c(c), F.lit(""))


def strip(c) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(text(c), F.lit(WHITE))


def _or(c: Column, spare) -> Column:
    """A text that isn't null, `spare` where it is empty; `c` is computed once, which it isn't where it stands in a condition and a branch."""
    return F.concat(c, F.when(c == "", spare).otherwise(""))


def let(c, rule) -> Column:
    """`rule` of a value that is computed once however often the rule names it; in filters Spark shares no common parts."""
    return F.element_at(F.transform(F.array(c), rule), 1)


def squeeze(c) -> Column:
    return strip(F.regexp_replace(text(c), r"(?U)\s+", " "))


def _sized(c: Column, cut=lambda c: F.lit(True)) -> Column:
    return let(c, lambda c: F.when(F.length(c) == 10, F.concat(c, F.lit("00"))).when((F.length(c) > 12) & cut(c), F.substring(c, 1, 12)).otherwise(c))


def clean_part_number(c) -> Column:
    return _sized(F.regexp_replace(text(c), rf"(?U)[\s\-.{DASHES}]+", ""))


def normalize_part_number(c) -> Column:
    own = F.regexp_replace(F.regexp_replace(text(c), f"[{DASHES}]", "-"), r"\.", "")
    own = F.regexp_replace(own, r"^[ ,.;:\-_]+|[ ,.;:\-_]+$", "")
    return _sized(own, lambda c: ~c.contains("-"))


def clean_description(c) -> Column:
    return strip(F.regexp_replace(text(c), rf"(?U)[\s.\-_,{DASHES}]+", " "))


def clean_remarks(c) -> Column:
    def rules(own: Column) -> Column:
        own = F.regexp_replace(own, r"(?iU)\b(UR|AB|YB)\b", "")
        own = F.regexp_replace(own, r"(?U)\(\s*\)", "")
        own = F.regexp_replace(own, r"(?U)[,/\\|\-–—]\s*[,/\\|\-–—]+", " ")
        own = squeeze(F.regexp_replace(own, r"(?U)^[\s,/\-–—.:;]+|[\s,/\-–—.:;]+$", ""))
        return let(own, lambda own: F.when(own.rlike("[A-Za-z0-9]"), own).otherwise(""))

    return let(text(c), lambda c: F.when(c.rlike("[A-Za-z0-9]"), rules(c)).otherwise(""))


def letter_suffix(i) -> Column:
    """A to Z, AA to ZZ, AAA and so on for 0, 1, 2, ...: the number in base 26 without a zero."""
    i = _c(i)
    digits, below, size = [], 0, 1
    for k in range(6):  # six letters number 321 million rows
        rest = F.floor((i - below) / size)
        digits.append(F.when(i >= below, F.chr((65 + F.pmod(rest, F.lit(26))).cast("int"))).otherwise(""))
        size *= 26
        below += size
    return F.concat(*reversed(digits))


def _upper_or(c, default: str) -> Column:
    return _or(F.upper(strip(c)), default)


def padded(number) -> Column:
    """Digits with a zero before a single one; other texts as they are."""
    number = strip(number)
    return F.when(number.rlike("^[0-9]$"), F.concat(F.lit("0"), number)).otherwise(number)


def catalogue_code(model, fig_name, fig_no="") -> Column:
    """YAM_{MODEL}_{NAME}; a figure without a name gives FIG nn or PARTS."""
    fig_no = F.lit(fig_no) if isinstance(fig_no, str) and fig_no == "" else _c(fig_no)
    code = F.upper(F.regexp_replace(F.regexp_replace(text(model), "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))
    name = F.upper(squeeze(F.regexp_replace(text(fig_name), "[^A-Za-z0-9&]+", " ")))
    spare = F.when(strip(fig_no) == "", "PARTS").otherwise(F.concat(F.lit("FIG "), padded(fig_no)))
    return F.concat(F.lit("YAM_"), _or(code, "MODEL"), F.lit("_"), _or(name, spare))


def image_record(model, fig_name, fig_no="") -> Column:
    return F.concat(catalogue_code(model, fig_name, fig_no), F.lit(".jpeg"))


def unquoted(c) -> Column:
    return strip(F.regexp_replace(strip(c), "^[\"']+|[\"']+$", ""))


def build_model_name_record(model, name, fig_name, brand="YAMAHA", omit_equal: bool = False) -> Column:
    """{BRAND} {MODEL} {name} Series {FIGURE}; omit_equal leaves out a name that equals the code."""
    brand = F.lit(brand) if isinstance(brand, str) else brand
    code, figure = _upper_or(model, "MODEL"), _upper_or(squeeze(fig_name), "PARTS")
    own = unquoted(name)
    middle = F.concat(F.lit(" "), own, F.when(strip(name) == "", "").otherwise(" "))
    middle = F.when(F.upper(own) == code, " ").otherwise(middle) if omit_equal else middle
    return F.concat(F.upper(strip(brand)), F.lit(" "), code, middle, F.lit("Series "), figure)


def detect_brand(c, fallback="YAMAHA") -> Column:
    fallback = F.lit(fallback) if isinstance(fallback, str) else fallback
    return F.when(text(c).rlike(r"(?iU)\bYAHAMA\b"), "YAHAMA").when(text(c).rlike(r"(?iU)\bYAMAHA\b"), "YAMAHA").otherwise(fallback)


def extract_raw_model_name(c, model=None, old_model=None) -> Column:
    """The vehicle's own name, without brand, codes, Series and figure."""
    own = strip(F.regexp_replace(strip(c), r"(?isU)\bSeries\b.*$", ""))
    own = strip(F.regexp_replace(own, r"(?iU)^(?:YAMAHA|YAHAMA)\s+", ""))
    for code in (old_model, model):
        if code is not None:
            key = F.regexp_replace(strip(code), r"\\E", "")
            own = strip(F.regexp_replace(own, F.concat(F.lit(r"(?iU)^\Q"), key, F.lit(r"\E(?:\s+|$)")), F.lit("")))  # an empty code cuts nothing from a stripped name
    own = strip(F.regexp_replace(own, r"(?U)^[A-Z0-9]{3,6}\s+(?=[\"A-Za-z0-9])", ""))
    return unquoted(F.regexp_replace(own, "^[A-Z0-9]{3,6}$", ""))


def format_parent_model_name(c, model, fig_name, brand="YAMAHA", old_model=None) -> Column:
    return build_model_name_record(model, extract_raw_model_name(c, model, old_model), fig_name, detect_brand(c, brand))


def recode(c, model) -> Column:
    """YAM_{old}_... as YAM_{model}_..."""
    given = F.regexp_replace(_c(model), r"([\\$])", r"\\$1")
    return F.regexp_replace(text(c), F.lit("^YAM_[A-Za-z0-9]+?_"), F.concat(F.lit("YAM_"), given, F.lit("_")))


def is_ref_no(c) -> Column:
    return F.regexp_replace(text(c), r"(?U)^[^\w*]+", "").rlike(r"^\*?\d{1,3}[A-Za-z]?$")


def safe_base_name(c, default: str = "document") -> Column:
    own = F.regexp_replace(F.regexp_replace(text(c), r"(?i)\.pdf$", ""), r'[\\/*?:"<>| ]', "_")
    own = F.regexp_replace(own, "^_+|_+$", "")
    return F.when(own == "", default).otherwise(own)


def code_from_filename(c, stop: list[str] = NO_FILE_CODE) -> Column:
    """The first token of four letters or digits of a file name, '' if there is none or it is one of `stop`; later tokens aren't tried."""
    found = F.regexp_extract(F.upper(text(c)), r"(?U)\b([A-Z0-9]{4})\b", 1)
    return F.when(found.isin(stop), "").otherwise(found)


# Words of file names that are no codes.
GENERIC = ["PARTS", "CATALOGUE", "CATALOG", "YAMAHA", "INDIA", "MODEL"]
_SHORT_CODE = r"(?U)\b([A-Z0-9]{3,6})\b"


def codes_from_filename(c) -> Column:
    """The tokens of three to six letters or digits of a file name, each once in order, without generic words."""
    found = F.regexp_extract_all(F.upper(text(c)), F.lit(_SHORT_CODE), F.lit(1))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(GENERIC)))


def short_code_from_filename(c, default: str = "MODEL") -> Column:
    """The first token of three to six letters or digits, whatever it says."""
    found = F.regexp_extract(F.upper(text(c)), _SHORT_CODE, 1)
    return F.when(found == "", default).otherwise(found)


def is_bike_file(c) -> Column:
    return text(c).rlike(r"(?iU)\bbike\b|_bike")


def parse_money(c) -> Column:
    """A number without thousands separators and currency sign, null where it isn't one."""
    return strip(F.regexp_replace(text(c), "[,₹]", "")).try_cast("double")


def parse_percent(c) -> Column:
    return strip(F.regexp_replace(text(c), "%", "")).try_cast("double")


def fit_dimensions(w, h, tw: int, th: int, mode: str = "aspect") -> Column:
    """width, height, left, top of an image within tw x th.

    aspect keeps the ratio and centres (half to even); percentage scales by tw
    per cent; edge limits the longer side to tw; exact takes tw x th.
    """
    w, h = _c(w), _c(h)
    if mode == "exact":
        return F.struct(F.lit(tw).alias("width"), F.lit(th).alias("height"), F.lit(0).alias("left"), F.lit(0).alias("top"))
    if mode == "aspect":
        scale = F.least(tw / w, th / h)
        x, y = (F.greatest(F.lit(1), F.rint(v * scale).cast("int")) for v in (w, h))
        return F.struct(x.alias("width"), y.alias("height"), F.floor((tw - x) / 2).cast("int").alias("left"), F.floor((th - y) / 2).cast("int").alias("top"))
    scale = F.lit(tw / 100) if mode == "percentage" else F.least(F.lit(1.0), tw / F.greatest(w, h))
    x, y = (F.greatest(F.lit(1), F.floor(v * scale + 0.5).cast("int")) for v in (w, h))
    return F.struct(x.alias("width"), y.alias("height"), F.lit(0).alias("left"), F.lit(0).alias("top"))


def is_valid_quantity(c) -> Column:
    return ~F.lower(strip(c)).isin(NO_QUANTITY)


def is_custom_section(flag="is_custom_section", name="fig_name") -> Column:
    return F.coalesce(_c(flag), F.lit(False)) | F.upper(strip(name)).isin(SECTIONS)
