"""Column functions over text: normal forms, error rates, typed values, slugs, categories.

All but NFKC are built-in expressions.  NULL gives NULL unless a function says otherwise.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Unicode-aware tools understand it; Java's ``\\s`` is ASCII only.
WS = r"[\s\x1c-\x1f\x85\xa0  -     　]"
#: The same characters; trimming by a list is far cheaper than by a pattern that is tried at every place.
SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
#: What ends a line.
EOL = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"

# Category keywords in tie order, and the labels of categories.
CATEGORY_KEYWORDS = (
    ("delivery_note", "納品書"), ("invoice", "請求書"), ("quotation", "見積書"), ("quotation", "御見積書"), ("receipt", "領収書"),
    ("order", "発注書"), ("order", "注文書"), ("inspection", "検収書"), ("statement", "取引明細"), ("tax_report", "確定申告"),
)
CATEGORY_LABELS = {
    "delivery_note": "納品書", "invoice": "請求書", "quotation": "見積書", "receipt": "領収書", "order": "発注書", "inspection": "検収書",
    "statement": "取引明細書", "tax_report": "税務書類", "letter": "レター", "other": "その他",
}


def nfkc(text: Column) -> Column:
    """NFKC form; ASCII text never leaves the JVM."""

    @F.pandas_udf(T.StringType())
    def normal(values: pd.Series) -> pd.Series:
        return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")

    return F.when(text.rlike(r"^[\x00-\x7F]*$"), text).otherwise(normal(text))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends (the normal form of ASCII text)."""
    return strip(F.regexp_replace(text, rf"{WS}+", " "))


def normal_form(text: Column) -> Column:
    """NFKC, collapsed: the form in which texts are compared."""
    return collapsed(nfkc(text))


def key_form(text: Column) -> Column:
    """NFKC without white space, lower case: the form in which labels are compared."""
    return F.lower(F.regexp_replace(nfkc(text), rf"{WS}+", ""))


def error_rate(reference: Column, read: Column) -> Column:
    """Edits per reference character, of texts in normal form; an empty reference gives 0 for empty text, else 1."""
    n = F.length(reference)
    return F.when(n > 0, F.levenshtein(reference, read) / n).when(F.length(read) == 0, 0.0).otherwise(1.0)


def lines(text: Column) -> Column:
    """The lines of a text, without an empty one behind a final line end; no lines for an empty text."""
    cut = F.split(text, EOL, -1)
    cut = F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(cut)


def category(text: Column) -> Column:
    """Document type by the keyword that comes first; ties by list order; NULL without any."""
    found = F.array(*[F.struct(F.instr(text, k).alias("at"), F.lit(i).alias("rank"), F.lit(kind).alias("kind")) for i, (kind, k) in enumerate(CATEGORY_KEYWORDS)])
    return F.array_min(F.filter(found, lambda s: s["at"] > 0))["kind"]


def category_label(kind: Column) -> Column:
    pairs = [F.lit(x) for pair in CATEGORY_LABELS.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[kind], kind)


_DATE = r"([0-9]{2,4})[年/\-.]([0-9]{1,2})[月/\-.]([0-9]{1,2})"


def typed_date(text: Column) -> Column:
    """The first date as YYYY-MM-DD; two-digit years are of this century; NULL without one. The calendar isn't checked."""
    y, m, d = (F.try_to_number(F.nullif(F.regexp_extract(text, _DATE, i), F.lit("")), F.lit("9999")).cast("int") for i in (1, 2, 3))
    return F.when(text.rlike(_DATE), F.format_string("%04d-%02d-%02d", F.when(y < 100, y + 2000).otherwise(y), m, d))


def typed_amount(text: Column) -> Column:
    """The digits of the first amount; NULL without one."""
    return F.nullif(F.replace(F.regexp_extract(text, r"[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+", 0), F.lit(","), F.lit("")), F.lit(""))


def typed_number(text: Column) -> Column:
    """The first number with sign and decimals, without separators; NULL without one."""
    return F.nullif(F.replace(F.regexp_extract(text, r"[-+]?[0-9][0-9,]*\.?[0-9]*", 0), F.lit(","), F.lit("")), F.lit(""))


def field_slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(strip(text)), "[^a-z0-9_]", "_")


def name_slug(text: Column) -> Column:
    """Lower case words joined by single hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def numberish(text: Column) -> Column:
    return text.rlike(r"^[\p{Nd},.\-¥￥%/年月日: ]+$")


def looks_amount(text: Column) -> Column:
    """Whether at least as many digits as letters remain without separators and currency marks."""
    rest = F.regexp_replace(text, r"[, 円¥￥]", "")
    digits, letters = F.regexp_count(rest, F.lit(r"\p{Nd}")), F.regexp_count(rest, F.lit(r"\p{L}"))
    return (digits >= 1) & (digits >= letters)


def without_breaks(text: Column, instead: str = "\n") -> Column:
    return F.regexp_replace(text, r"(?i)<br\s*/?>", instead)


def guarded_cell(text: Column) -> Column:
    """Spreadsheet cells that would be read as formulas get a leading apostrophe."""
    return F.when(text.rlike("^[=+\\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def stem(name: Column) -> Column:
    return F.when(F.instr(name, ".") > 0, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def suffix(name: Column) -> Column:
    """Lower-case suffix with its point; empty without one."""
    return F.lower(F.regexp_extract(name, r"[^/\\.](\.[^./\\]*)$", 1))


def without_secret(text: Column, secret: str) -> Column:
    return F.replace(text, F.lit(secret), F.lit("***")) if secret else text


def common_affix(a: Column, b: Column) -> Column:
    """struct(prefix, suffix): lengths of the longest common prefix and of the common suffix behind it."""
    n = F.least(F.length(a), F.length(b))

    def run(same, limit: Column) -> Column:  # length of the leading run for which ``same`` holds
        end = F.aggregate(F.sequence(F.lit(1), F.greatest(limit, F.lit(1))), F.struct(F.lit(0).alias("k"), F.lit(True).alias("on")), lambda s, i: F.when(s["on"] & (i <= limit) & same(i), F.struct(i.alias("k"), F.lit(True).alias("on"))).otherwise(F.struct(s["k"].alias("k"), F.lit(False).alias("on"))))
        return end["k"]

    prefix = run(lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1)), n)
    ends = F.transform(F.array(prefix), lambda p: F.struct(p.alias("prefix"), run(lambda i: F.substring(a, F.length(a) - i + 1, F.lit(1)) == F.substring(b, F.length(b) - i + 1, F.lit(1)), n - p).alias("suffix")))
    return ends[0]


# Chinese forms of characters that multilingual recognisers emit in Japanese text, and the Japanese forms.
CHINESE = "爱纳单稅额别况錄录览覽历歷详确变變拔拨处處间问开关报设计记货价顾顯机级组线编认证验险务员购销费资质选达运邮银钱铁总统继续绝终结给绿网"
JAPANESE = "愛納単税額別況録録覧覧歴歴詳確変変抜抜処処間問開関報設計記貨価顧顕機級組線編認証験険務員購銷費資質選達運郵銀銭鉄総統継続絶終結給緑網"


def japanese_forms(text: Column) -> Column:
    """Text with the Japanese forms of characters that a recogniser gave in Chinese ones."""
    return F.translate(text, CHINESE, JAPANESE)


def site_slug(text: Column) -> Column:
    """As :func:`name_slug`, of at most 63 characters."""
    return F.substring(name_slug(text), 1, 63)


def original_path(company: Column, document: Column, name: Column) -> Column:
    """Where the file of a document is stored, below the data folder."""
    return F.concat_ws("/", company, F.lit("documents"), document, F.concat(F.lit("original"), F.coalesce(F.nullif(suffix(name), F.lit("")), F.lit(".bin"))))


def page_image_path(company: Column, document: Column, page_number: Column) -> Column:
    return F.concat_ws("/", company, F.lit("documents"), document, F.lit("pages"), F.concat(F.lit("p"), page_number.cast("string"), F.lit(".png")))


def markdown_path(company: Column, document: Column) -> Column:
    return F.concat_ws("/", company, F.lit("documents"), document, F.lit("results"), F.lit("document.md"))


def folder_path(typed: Column) -> Column:
    """A folder's path as typed or pasted, without the white space and the quotes around it."""
    bare = strip(F.coalesce(typed, F.lit("")))
    return F.when((F.length(bare) >= 2) & bare.startswith('"') & bare.endswith('"'), strip(F.regexp_replace(bare, '^"|"$', ""))).otherwise(bare)


def first_needle(kind: Column, markdown: Column) -> Column:
    """What of a region is looked for in a page: the first 30 characters, of a table's first filled cell."""
    cells = F.filter(F.transform(F.split(F.get(F.split(markdown, "\n"), F.lit(0)), r"\|", -1), strip), lambda c: (c != "") & ~c.rlike(r"^[-\s]+$"))
    return F.substring(collapsed(F.when(kind == "table", F.coalesce(F.get(cells, F.lit(0)), F.lit(""))).otherwise(markdown)), 1, 30)


def record_summary(values: Column) -> Column:
    """The first two filled values of an array, joined by a dash."""
    return F.array_join(F.slice(F.filter(values, lambda v: v.isNotNull() & (v != "")), 1, 2), " — ")


def online(last_seen: Column, now: Column) -> Column:
    """Whether a device was seen less than ten minutes ago; never seen is no."""
    return F.coalesce(F.unix_micros(now) - F.unix_micros(last_seen) < 600_000_000, F.lit(False))
