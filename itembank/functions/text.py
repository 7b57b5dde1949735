"""Text normalisation as Spark columns.

Everything here is a JVM-side expression except NFKC, which Spark has no
built-in for; the pandas UDF behind ``nfkc`` only ships non-ASCII values.
Java's ``\\s`` and ``\\d`` are ASCII unless ``(?U)`` is set, so patterns on short
fields set it. Long fields use ``translate`` and ``btrim`` over an explicit
whitespace set, which cost a fraction of a Unicode regex.
"""
from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Word lists, punctuation and label patterns that results depend on.
PUNCTUATION = "，。、“”‘’；：！？,.\"';:!?()[]{}<>《》【】（）"
GROUP_LABEL = r"(?U)\A\s*【\s*(?:题组\s*\d+\s*[-—–~至]\s*\d+|\d+\s*[-—–~至]\s*\d+\s*为题[组目])\s*】[ \t]*"
OPTION_LABEL = r"(?U)^\s*[A-ZＡ-Ｚ][.．、:：)）]\s*"
EMBEDDED_LABEL = r"(?Um)^\s*([A-Z])[.．、:：)）]\s*"
EMBEDDED_CUE = "判断|选项|说法|正误"
TITLE_WORDS = "参考答案与解析|参考答案及解析|参考答案|答案与解析|答案及解析|答案解析|答案|解析|副本"
GROUP_WORDS = "参考答案|答案及解析|答案解析|答案|解析|试题|题目|副本"
DEFAULT_TAG = "其他"
NOTE_HEAD = "[人工补充]\n"
REDACTED = "[REDACTED]"
UNCERTAIN = "<uncertain>"
TRUE_FALSE_CUE = "正误|逐[项一].*判断"
FLAG_NOT_TF = "判断题答案不是 T/F 序列"
FLAG_TF_COUNT = "判断题答案数量与选项不符"

# All characters Python counts as whitespace, as text and as a Java character class.
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
WS_CLASS = "[" + "".join(f"\\x{{{ord(ch):x}}}" for ch in WHITESPACE) + "]"


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Trim all Unicode whitespace on both ends."""
    return F.btrim(as_col(c), F.lit(WHITESPACE))


def rstrip(c) -> Column:
    return F.rtrim(as_col(c), F.lit(WHITESPACE))


def ws_free(c) -> Column:
    return F.translate(as_col(c), WHITESPACE, "")


def ws_key(c) -> Column:
    """Comparison key: null becomes empty, every whitespace character goes, case stays."""
    return ws_free(F.coalesce(as_col(c).cast("string"), F.lit("")))


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def nfkc(c) -> Column:
    """NFKC form. ASCII values never leave the JVM: they reach the UDF as nulls."""
    c = as_col(c)
    return F.coalesce(_nfkc(F.when(c.rlike(r"[^\x00-\x7f]"), c)), c)


def casefold(c) -> Column:
    """Lower case plus the folds ``lower`` leaves out."""
    out = F.lower(as_col(c))
    for char, fold in (("ß", "ss"), ("ς", "σ"), ("ſ", "s")):  # fixed values
        out = F.replace(out, F.lit(char), F.lit(fold))
    return out


def json_text(c) -> Column:
    """A string (or null) as a JSON scalar."""
    wrapped = F.to_json(F.array(as_col(c)))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


# --- duplicate keys ---------------------------------------------------------------------------

def dedupe_part(c, label: bool = True, compat: bool = False) -> Column:
    """One field of the duplicate key: lower case, no whitespace, no punctuation, no question label.

    ``compat`` strips punctuation first and then any leading digits, also on options, so that
    ``3.5%`` loses its number and the options ``10`` and ``20`` compare equal.
    """
    text = F.lower(F.coalesce(as_col(c).cast("string"), F.lit("")))
    if compat:
        return F.regexp_replace(F.translate(text, WHITESPACE + PUNCTUATION, ""), r"(?U)\A第?\d+[题、.)．]?", "")
    if label:
        text = F.regexp_replace(ws_free(text), r"(?U)\A第?\d+(?:题|[、)．]|\.(?!\d))", "")
    return F.translate(text, WHITESPACE + PUNCTUATION, "")


def dedupe_key(stem, options, answer=None, compat: bool = False) -> Column:
    opts = F.array_join(
        F.transform(
            F.coalesce(as_col(options), F.array().cast("array<string>")),
            lambda o: dedupe_part(o, label=False, compat=compat),
        ),
        "",
    )
    parts = [dedupe_part(stem, compat=compat), opts]
    if answer is not None:
        parts.append(dedupe_part(answer, label=False, compat=compat))
    return F.concat_ws("|", *parts)


def dedupe_text(stem, options) -> Column:
    """Display text of a row in a duplicate report."""
    flat = lambda c: strip(F.translate(c, "\n", " "))
    opts = F.array_join(F.transform(F.coalesce(as_col(options), F.array().cast("array<string>")), flat), " ")
    return strip(F.concat_ws(" ", flat(F.coalesce(as_col(stem), F.lit(""))), opts))


# --- question labels --------------------------------------------------------------------------

def number_text(c) -> Column:
    """A known question number as bare text."""
    return F.regexp_replace(strip(F.coalesce(as_col(c).cast("string"), F.lit(""))), r"[.．、]+\z", "")


def _label(number: Column | str) -> Column:
    """Pattern text of a printed label of ``number`` followed by something on the same line.

    The group is atomic: without it a label that ends its line would give back its colon and match.
    """
    n = F.lit(number) if isinstance(number, str) else number
    return F.concat(
        F.lit(r"(?>第[^\S\n]*"), n, F.lit(r"[^\S\n]*题[^\S\n]*[:：.．、]?|"), n,
        F.lit(r"[^\S\n]*[.．、](?!\d))[ \t]*(?=[^\n]*\S)"),
    )


def clean_stem(stem, number=None) -> Column:
    """Drop a leading group label and one printed question label.

    Line 1 loses its label if the number is unknown or equal; a later line only if the number is
    known, equal, and a group label was removed. A label with nothing after it on its line stays.
    """
    stem = as_col(stem)
    text = F.regexp_replace(stem, GROUP_LABEL, "")
    any_label = F.regexp_replace(text, F.concat(F.lit(r"(?U)\A([ \t]*)"), _label(r"\d{1,3}")), F.lit("$1"))
    if number is None:
        return any_label
    known = number_text(number)
    # A later line counts only below a removed group label; the lazy dot finds the first such line.
    head = F.when(text != stem, F.lit(r"(?Us)\A(.*?)(?<![^\n])([ \t]*)")).otherwise(F.lit(r"(?U)\A()([ \t]*)"))
    own_label = F.regexp_replace(text, F.concat(head, _label(known)), F.lit("$1$2"))
    return (
        F.when(known == "", any_label)
        .when(known.rlike(r"(?U)\A\d{1,3}\z"), own_label)
        .otherwise(text)
    )


def display_stem(rows: DataFrame) -> Column:
    """``stem`` without its printed label. The known number is the first of ``number``, ``agent_source.number`` and ``original_number``
    that is there and not blank; a label of another number is part of the text and stays."""
    known = [F.col(c) for c in ("number", "original_number") if c in rows.columns]
    source = rows.schema["agent_source"].dataType if "agent_source" in rows.columns else None
    if source is not None and "number" in getattr(source, "names", []):
        known.insert(1 if "number" in rows.columns else 0, F.col("agent_source.number"))
    if not known:
        return clean_stem("stem")
    return clean_stem("stem", F.coalesce(*[F.nullif(number_text(k), F.lit("")) for k in known], F.lit("")))


def removed_number(stem) -> Column:
    """The number printed in a leading label, empty if there is none."""
    text = F.regexp_replace(as_col(stem), GROUP_LABEL, "")
    pattern = r"(?U)\A[ \t]*(?:第\s*(\d{1,3})\s*题|(\d{1,3})\s*[.．、](?!\d))"
    return F.concat(F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2))


def normalize_stem(stem, number, original_number=None) -> tuple[Column, Column]:
    """(stem without its label, original_number): the removed number is kept if none was known."""
    known = F.coalesce(F.nullif(number_text(number), F.lit("")), *([as_col(original_number)] if original_number is not None else []))
    cleaned = clean_stem(stem, known)
    found = F.nullif(removed_number(stem), F.lit(""))
    keep = F.lit(None).cast("string") if original_number is None else as_col(original_number)
    missing = number_text(number) == ""
    return cleaned, F.when(missing & (cleaned != as_col(stem)), F.coalesce(keep, found)).otherwise(keep)


# --- options, tags, answers -------------------------------------------------------------------

def clean_options(options) -> Column:
    """Strip one printed letter label per option."""
    return F.transform(
        F.coalesce(as_col(options), F.array().cast("array<string>")),
        lambda o: strip(F.regexp_replace(o, OPTION_LABEL, "")),
    )


def option_lines(c) -> Column:
    """Non-blank stripped lines of a text field."""
    return F.filter(F.transform(F.split(as_col(c), r"\r\n|[\n\r]"), strip), lambda o: o != "")


def clean_option_text(options) -> Column:
    """Form variant: blank options go, then ``A.`` and ``(A)`` labels A–H in either case."""
    def one(o):
        o = strip(F.regexp_replace(strip(o), r"(?U)\A\s*[A-Ha-h][.、:：)]\s*", ""))
        return strip(F.regexp_replace(o, r"(?U)\A\s*[（(][A-Ha-h][）)]\s*", ""))

    return F.transform(F.filter(as_col(options), lambda o: strip(o) != ""), one)


def split_embedded_options(stem, options) -> Column:
    """Struct(stem, options, split): options printed at the end of the stem become real options."""
    stem, existing = as_col(stem), F.coalesce(as_col(options), F.array().cast("array<string>"))
    labels = F.regexp_extract_all(stem, F.lit(EMBEDDED_LABEL), 1)
    n = F.size(labels)
    parts = F.split(stem, EMBEDDED_LABEL, -1)
    found = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), strip)
    well_formed = (
        n.between(2, 10)
        & (F.array_join(labels, "") == F.substring(F.lit("ABCDEFGHIJ"), F.lit(1), n))
        & F.forall(found, lambda o: o != "")
    )
    same = (F.size(existing) > 0) & (
        F.transform(clean_options(existing), ws_free) == F.transform(found, ws_free)
    )
    bare = (F.size(existing) == 0) & (n == 4) & parts[0].rlike(EMBEDDED_CUE)
    split = well_formed & (same | bare)
    head = rstrip(parts[0])
    return F.struct(
        F.when(split, head).otherwise(stem).alias("stem"),
        F.when(split & (F.size(existing) == 0), found).otherwise(existing).alias("options"),
        split.alias("split"),
    )


def normalize_tags(tags, category=None) -> Column:
    """Ordered distinct tags; a string is split on commas and whitespace first."""
    tags = as_col(tags)
    bare = lambda t: F.regexp_replace(strip(t), r"\A#+", "")
    parts = F.transform(tags, bare)
    if category is not None:
        parts = F.concat(F.array(bare(as_col(category))), parts)
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def tag_list(c) -> Column:
    return normalize_tags(F.split(F.coalesce(as_col(c), F.lit("")), r"(?U)[，,\s]+"))


def merge_tags(question_tags, solution_tags) -> Column:
    """Question tags, then solution tags, without repeats; a default tag if there are none."""
    merged = F.array_distinct(F.filter(F.concat(as_col(question_tags), as_col(solution_tags)), lambda t: t != ""))
    return F.when(F.size(merged) > 0, merged).otherwise(F.array(F.lit(DEFAULT_TAG)))


def tag_line(tags) -> Column:
    return F.array_join(F.transform(F.filter(as_col(tags), lambda t: t != ""), lambda t: F.concat(F.lit("#"), t)), " ")


def format_remark(tags, explanation, note=None) -> Column:
    """Tag line, explanation and an optional note, each on its own line if not blank."""
    blank_to_null = lambda c: F.nullif(strip(F.coalesce(c, F.lit(""))), F.lit(""))
    blocks = [blank_to_null(tag_line(tags)), blank_to_null(as_col(explanation))]
    if note is not None:
        blocks.append(F.concat(F.lit(NOTE_HEAD), blank_to_null(as_col(note))))
    return F.concat_ws("\n", *blocks)


def normalize_answer(c, ascii_only: bool = False) -> Column:
    """NFKC and strip; an answer made only of T and F loses separators and is upper-cased."""
    c = F.coalesce(as_col(c).cast("string"), F.lit(""))
    value = strip(c if ascii_only else nfkc(c))
    compact = F.upper(F.regexp_replace(value, r"(?U)[\s,，、;；/]+", ""))
    return F.when(compact.rlike(r"\A[TF]+\z"), compact).otherwise(value)


def tf_question(stem, answer_format=None) -> Column:
    cue = F.coalesce(as_col(stem), F.lit("")).rlike(TRUE_FALSE_CUE)
    return cue if answer_format is None else (F.coalesce(as_col(answer_format), F.lit("")) == "true_false") | cue


def format_flags(stem, options, normalized_answer, answer_format=None) -> Column:
    """Flags of a true/false question whose answer has the wrong shape."""
    answer, n = as_col(normalized_answer), F.size(F.coalesce(as_col(options), F.array().cast("array<string>")))
    relevant = (answer != "") & tf_question(stem, answer_format)
    is_tf = answer.rlike(r"\A[TF]+\z")
    return F.array_compact(
        F.array(
            F.when(relevant & ~is_tf, F.lit(FLAG_NOT_TF)),
            F.when(relevant & is_tf & (n > 0) & (F.length(answer) != n), F.lit(FLAG_TF_COUNT)),
        )
    )


def normalize_number(c, ascii_only: bool = False) -> Column:
    c = F.coalesce(as_col(c).cast("string"), F.lit(""))
    return F.regexp_replace(strip(c if ascii_only else nfkc(c)), r"[.、]+\z", "")


# --- identities and corpora -------------------------------------------------------------------

def fingerprint(stem, options, number=None) -> Column:
    """Content hash of a question: label-free stem and options, whitespace ignored."""
    return content_digest(clean_stem(stem, number), options)


def content_digest(cleaned, options) -> Column:
    """Content hash from a stem whose label is gone."""
    return F.sha2(ws_free(F.concat(as_col(cleaned), F.to_json(clean_options(options)))), 256)


def identity(source_hash, number, section, stem) -> Column:
    """Optimistic-check token of a question; the text hashed is a JSON array with ``, `` separators."""
    return F.sha2(
        F.concat(F.lit("["), F.concat_ws(", ", *[json_text(c) for c in (source_hash, number, section, stem)]), F.lit("]")),
        256,
    )


def title_key(c, ascii_only: bool = False) -> Column:
    title = as_col(c) if ascii_only else nfkc(c)
    return F.regexp_replace(F.regexp_replace(title, TITLE_WORDS, ""), r"(?U)[\s_\-—:：,，.。()（）]+", "")


def group_name(c) -> Column:
    """Paper name from a file path: extension, answer words and separators go."""
    base = F.regexp_extract(as_col(c), r"([^/\\]*)\z", 1)
    base = F.when(base.rlike(r"\A.+\.[^.]+\z"), F.regexp_replace(base, r"\.[^.]+\z", "")).otherwise(base)
    return F.regexp_replace(F.regexp_replace(base, GROUP_WORDS, ""), r"(?U)[\s_\-（）()]+", "")


def once(c: Column, use) -> Column:
    """``use(value)`` with ``c`` evaluated once per row, however often ``use`` mentions it.

    Catalyst inlines an aliased expression into every place a predicate names it; a lambda variable
    holds its value.
    """
    return F.transform(F.array(c), use)[0]


def search_corpus(stem, answer, remark, image, options, collapse: bool = True) -> Column:
    """Lower-cased searchable text with single spaces.

    ``collapse=False`` leaves whitespace alone, which no keyword without whitespace can notice.
    """
    fields = [F.coalesce(as_col(c), F.lit("")) for c in (stem, answer, remark, image)]
    fields.append(F.array_join(F.coalesce(as_col(options), F.array().cast("array<string>")), " "))
    text = F.lower(F.concat_ws(" ", *fields))
    return strip(F.regexp_replace(text, WS_CLASS + "+", " ")) if collapse else text


def select_corpus(stem, options, tags, remark, compat: bool = False) -> Column:
    """Case-folded selection text. ``compat`` uses the JSON text, where field names match too."""
    stem, options, tags, remark = (as_col(c) for c in (stem, options, tags, remark))
    if compat:
        arr = lambda a: F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(a, json_text), ", "), F.lit("]")), F.lit("null"))
        return casefold(F.concat(
            F.lit('{"stem": '), json_text(stem), F.lit(', "options": '), arr(options),
            F.lit(', "category_tags": '), arr(tags), F.lit(', "remark": '), json_text(remark), F.lit("}"),
        ))
    return casefold(F.concat_ws("\n", stem, F.array_join(options, "\n"), F.array_join(tags, "\n"), remark))


def ocr_compare(c, ascii_only: bool = False) -> Column:
    """Comparison form of recognised text: NFKC, no whitespace, plain dashes."""
    return F.translate(ws_free(as_col(c) if ascii_only else nfkc(c)), "–—", "--")


def strip_field_label(c, field, number) -> Column:
    """Remove the exact number of a stem or the letter of an option."""
    text = strip(c)
    own = F.concat(F.lit(r"(?U)\A\Q"), as_col(number).cast("string"), F.lit(r"\E[.．、]\s*"))
    return F.when(as_col(field) == "stem", F.regexp_replace(text, own, F.lit(""))).otherwise(
        F.regexp_replace(text, r"(?U)\A[A-Z][.．、]\s*", "")
    )


# --- model replies ----------------------------------------------------------------------------

def parse_model_json(c) -> Column:
    """The JSON object in a model reply as a variant; null if there is none.

    Code fences go; text that is not an object is retried between its first and last brace.
    """
    text = strip(F.coalesce(as_col(c), F.lit("")))
    text = strip(F.regexp_replace(text, r"(?i)\A```(?:json)?", ""))
    text = strip(F.regexp_replace(text, r"```\z", ""))
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    whole = F.try_parse_json(text)
    # A valid value that is not an object counts as no answer and is not retried.
    return F.when(whole.isNotNull(), F.when(text.startswith("{"), whole)).otherwise(
        F.try_parse_json(F.nullif(inner, F.lit("")))
    )


def model_items(parsed) -> Column:
    """Items of a reply: object with ``items``, bare list, or one record. Input is a variant."""
    v = as_col(parsed)
    listed = F.try_variant_get(v, "$.items", "array<variant>")
    bare = F.try_variant_get(v, "$", "array<variant>")
    return F.when(listed.isNotNull(), listed).when(bare.isNotNull(), bare).when(
        F.try_variant_get(v, "$.kind", "string").isin("question", "solution"), F.array(v)
    )


def message_content(parts) -> Column:
    """Message text from a list of parts with ``text`` or ``content``."""
    return F.array_join(
        F.transform(as_col(parts), lambda p: F.coalesce(F.nullif(p["text"], F.lit("")), p["content"], F.lit(""))), ""
    )


def redact(c, secrets: list[str], mark: str = REDACTED) -> Column:
    """Replace known literal secrets."""
    out = as_col(c)
    for secret in secrets:
        if secret:
            out = F.replace(out, F.lit(secret), F.lit(mark))
    return out


def leaks(c, secrets: list[str], min_length: int = 9) -> Column:
    """Number of known secrets, longer than 8 characters, that a value contains."""
    found = F.lit(0)
    for secret in secrets:
        if len(secret) >= min_length:
            found = found + as_col(c).contains(secret).cast("int")
    return found


def mask_key(c) -> Column:
    key = F.trim(F.coalesce(as_col(c), F.lit("")))
    n = F.length(key)
    return (
        F.when(n == 0, F.lit("no-key"))
        .when(n <= 8, F.repeat(F.lit("*"), n))
        .otherwise(F.concat(F.substring(key, 1, 4), F.lit("..."), F.substring(key, -4, 4)))
    )


# --- geometry and previews --------------------------------------------------------------------

def region_error(page, bbox, pages, min_span: float = 15) -> Column:
    """Why a figure box is invalid; null if it is fine. Coordinates run 0–1000."""
    b = as_col(bbox)
    l, t, r, bt = (F.get(b, F.lit(i)) for i in range(4))
    shape = b.isNotNull() & (F.size(b) == 4) & F.forall(b, lambda v: v.isNotNull() & ~F.isnan(v))
    inside = (l >= 0) & (l < r) & (r <= 1000) & (t >= 0) & (t < bt) & (bt <= 1000)
    return (
        F.when(~F.coalesce(F.array_contains(as_col(pages), as_col(page)), F.lit(False)), F.lit("page"))
        .when(~F.coalesce(shape, F.lit(False)), F.lit("shape"))
        .when(~inside, F.lit("bounds"))
        .when((r - l < min_span) | (bt - t < min_span), F.lit("span"))
    )


def map_local_box(box, roi, width, height) -> Column:
    """A 0–1000 box inside a pixel region of interest, in 0–1000 page coordinates."""
    b, o = as_col(box), as_col(roi)
    w, h = as_col(width), as_col(height)
    x = lambda v: F.round((o[0] + v / 1000 * (o[2] - o[0])) / w * 1000, 4)
    y = lambda v: F.round((o[1] + v / 1000 * (o[3] - o[1])) / h * 1000, 4)
    return F.array(x(b[0]), y(b[1]), x(b[2]), y(b[3]))


def outer_boxes(figures, keys: list[str], box: str = "bbox"):
    """Smallest box around all boxes of a group, as columns l, t, r, b."""
    b = F.col(box)
    return figures.groupBy(*keys).agg(
        F.min(b[0]).alias("l"), F.min(b[1]).alias("t"), F.max(b[2]).alias("r"), F.max(b[3]).alias("b")
    )


def ellipsis(c, width: int) -> Column:
    flat = strip(F.translate(F.coalesce(as_col(c), F.lit("")), "\n", " "))
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width), F.lit("..."))).otherwise(flat)


def choice_label(number, stem, answer) -> Column:
    """``n | stem… | 答案:x``"""
    answer = strip(F.translate(F.coalesce(as_col(answer), F.lit("")), "\n", " "))
    return F.concat(as_col(number).cast("string"), F.lit(" | "), ellipsis(stem, 88), F.lit(" | 答案:"), answer)
