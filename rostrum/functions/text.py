"""Text functions as native column expressions. A null is taken as the empty string unless said otherwise."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from rostrum.functions.letters import plain_letters


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def r3(x) -> Column:
    """Three decimals, halves up on the decimal value, so that engines agree on binary doubles."""
    return F.round(_c(x).cast("decimal(18,9)"), 3).cast("double")


def words(x) -> Column:
    return F.filter(F.split(_c(x), r"\s+"), lambda w: w != "")


def title_name(x) -> Column:
    """Each run of letters capitalised, whatever stands before it (o'neil -> O'Neil); white space collapsed."""
    runs = F.regexp_extract_all(F.trim(_c(x)), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    first = lambda t: F.when(F.startswith(t, F.lit("ß")), "Ss").otherwise(F.upper(F.substring(t, 1, 1)))
    cased = F.transform(runs, lambda t: F.concat(first(t), F.lower(F.substr(t, F.lit(2)))))
    return F.coalesce(F.array_join(words(F.array_join(cased, "")), " "), F.lit(""))


def slug_name(x) -> Column:
    """Without accents and other combining marks (NFKD), in lower case, without dots; spaces and hyphens as underscores, none at the ends."""
    plain = F.lower(plain_letters(F.coalesce(_c(x), F.lit(""))))
    return F.regexp_replace(F.translate(plain, " -.", "__"), r"^_+|_+$", "")


def plain_name(x) -> Column:
    """Lower case, trimmed, without anything but word characters and white space."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(_c(x), F.lit("")))), r"[^\p{L}\p{N}_\s]", "")


def norm_lower(x) -> Column:
    return F.coalesce(F.lower(F.trim(_c(x))), F.lit(""))


def norm_strip(x) -> Column:
    return F.coalesce(F.trim(_c(x)), F.lit(""))


def matching_key(x) -> Column:
    """Letters, digits, space, underscore and hyphen, in lower case."""
    return F.lower(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"[^\p{L}\p{N} _-]", ""))


def file_name(x) -> Column:
    """Spaces and hyphens as underscores; only letters, digits and underscores stay."""
    return F.regexp_replace(F.translate(F.coalesce(_c(x), F.lit("")), " -", "__"), r"[^\p{L}\p{N}_]", "")


def sentences(x, least: int = 3) -> Column:
    """Cut after each . ! ? (line ends count as spaces); pieces of at least ``least`` words."""
    flat = F.replace(F.coalesce(_c(x), F.lit("")), F.lit("\n"), F.lit(" "))
    cut = F.transform(F.regexp_extract_all(flat, F.lit(r"[^.!?]*[.!?]|[^.!?]+$"), F.lit(0)), lambda s: F.trim(s))
    return F.filter(cut, lambda s: F.size(words(s)) >= least)


def phrase_tokens(x) -> Column:
    """Comma, slash and semicolon parts, and white-space words of the phrase itself, in lower case, distinct."""
    x = F.coalesce(_c(x), F.lit(""))
    both = F.concat(F.split(F.translate(x, "/;", ",,"), ","), words(x))
    return F.array_distinct(F.filter(F.transform(both, lambda t: F.lower(strip(t))), lambda t: t != ""))


def distinct_ci(arr) -> Column:
    """Trimmed, without blanks, first spelling kept of those equal in lower case."""
    clean = F.filter(F.transform(F.coalesce(_c(arr), F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t.isNotNull() & (t != ""))
    return F.aggregate(clean, F.array().cast("array<string>"), lambda a, t: F.when(F.exists(a, lambda y: F.lower(y) == F.lower(t)), a).otherwise(F.array_append(a, t)))


def tagged(tags, prefix: str) -> Column:
    """What follows ``prefix`` in the tags that start with it, trimmed."""
    own = F.filter(F.coalesce(_c(tags), F.array().cast("array<string>")), lambda t: t.startswith(prefix))
    return F.transform(own, lambda t: F.trim(F.substr(t, F.lit(len(prefix) + 1))))


def hr_note(tag) -> Column:
    """HR_NOTE:k=v;k=v to a struct; a missing or bad impact is 0.5. Keys and values are trimmed; of a repeated key the last counts.

    Parts without = are left out. A null tag gives nulls and 0.5."""
    parts = F.filter(F.split(F.substr(_c(tag), F.lit(9)), ";"), lambda p: F.contains(p, F.lit("=")))
    pairs = F.transform(parts, lambda p: F.struct(strip(F.substring_index(p, "=", 1)).alias("k"), strip(F.substr(p, F.instr(p, "=") + 1)).alias("v")))
    part = lambda k: F.try_element_at(F.filter(pairs, lambda x: x.k == k), F.lit(-1)).v
    return F.struct(
        F.coalesce(part("category"), part("cat")).alias("category"), part("type").alias("type"), part("note").alias("note"),
        F.coalesce(part("impact").try_cast("double"), F.lit(0.5)).alias("impact"),
    )


def boost_line(*arrays) -> Column:
    """All skills in lower case, sorted, distinct, joined by a comma and a space."""
    every = F.flatten(F.array(*[F.coalesce(_c(a), F.array().cast("array<string>")) for a in arrays]))
    low = F.filter(F.transform(every, lambda s: F.lower(F.trim(s))), lambda s: s != "")
    return F.array_join(F.array_sort(F.array_distinct(low)), ", ")


def strip(x) -> Column:
    """Without white space at either end, line ends and tabs included; a pattern would look at every space of a long text."""
    return F.trim(_c(x), F.lit(" \t\n\x0b\f\r"))


def candidate_id(email, phone, name, file) -> Column:
    """Prefix and 12 hex digits of SHA-256 over the first of e-mail, phone, name in title form and file stem that is given."""
    given = lambda x: F.when(strip(x) != "", strip(x))
    mail, tel, who = F.lower(given(email)), F.translate(given(phone), " -()", ""), title_name(name)
    tel, who = F.when(tel != "", tel), F.when(who != "", who)
    stem = F.coalesce(F.regexp_replace(F.regexp_extract(_c(file), r"([^/]+)$", 1), r"(?<=.)\.[^.]*$", ""), F.lit(""))
    key = F.coalesce(F.concat(F.lit("email:"), mail), F.concat(F.lit("phone:"), tel), F.concat(F.lit("name:"), who), F.concat(F.lit("file:"), stem))
    local = F.when(F.contains(mail, F.lit("@")), F.substring_index(mail, "@", 1)).when(mail.isNotNull(), "cand")
    prefix = F.substring(F.coalesce(local, F.lower(F.replace(who, F.lit(" "), F.lit(""))), stem), 1, 8)
    return F.concat(prefix, F.lit("_"), F.substring(F.sha2(key, 256), 1, 12))


def seniority(given, text, inferred=None) -> Column:
    """The given level, else the first that the text names, else the inferred one, else Unspecified."""
    t = F.lower(F.coalesce(_c(text), F.lit("")))
    has = lambda *k: F.exists(F.array(*map(F.lit, k)), lambda w: F.contains(t, w))
    return (
        F.when(_c(given) != "", _c(given)).when(has("principal"), "Principal").when(has("lead") & ~has("tech lead"), "Lead").when(has("senior"), "Senior")
        .when(has("mid-level", "mid level", "midlevel"), "Mid").when(has("junior", "entry level", "fresher"), "Junior")
        .otherwise(F.coalesce(F.lit(None).cast("string") if inferred is None else _c(inferred), F.lit("Unspecified")))
    )


#: Patterns of the years that a note asks for, and of those that criteria ask for.
NOTED_SPAN = r"(\d+)\s*[-–—to]+\s*(\d+)\s*years?"
NOTED_LEAST = r"(?:at least|minimum|min|more than|over)\s*(\d+)\s*years?"
NOTED_EXACT = r"(\d+)\s*years?\s*(?:of|experience|exp)"
NOTED_PLUS = r"(\d+)\s*\+\s*years?"
CRITERIA_SPAN = r"(\d+)\s*-\s*(\d+)\s*years?"
CRITERIA_LEAST = r"(?:at least|minimum|min)\s*(\d+)"
CRITERIA_MOST = r"(?:up to|maximum|max)\s*(\d+)"
CRITERIA_EXACT = r"(\d+)\s*years?"


def experience_range(x) -> Column:
    """(low, high) years that a note asks for: a range; at least N; N years (to N + 2); N+ years; null if none."""
    t = F.lower(F.coalesce(_c(x), F.lit("")))
    num = lambda p, g=1: F.regexp_extract(t, p, g).try_cast("double")
    span, least, exact, plus = NOTED_SPAN, NOTED_LEAST, NOTED_EXACT, NOTED_PLUS
    pair = lambda lo, hi: F.struct(lo.alias("low"), hi.cast("double").alias("high"))
    none = F.lit(None).cast("double")
    return (
        F.when(num(span).isNotNull(), pair(num(span), num(span, 2))).when(num(least).isNotNull(), pair(num(least), none))
        .when(num(exact).isNotNull(), pair(num(exact), num(exact) + 2)).when(num(plus).isNotNull(), pair(num(plus), none))
    )


def criteria_range(x) -> Column:
    """As ``experience_range``, for criteria: range, at least (no upper end), up to (from 0), exact (one either side)."""
    t = F.lower(F.coalesce(_c(x), F.lit("")))
    num = lambda p, g=1: F.regexp_extract(t, p, g).try_cast("double")
    span, least, most, exact = CRITERIA_SPAN, CRITERIA_LEAST, CRITERIA_MOST, CRITERIA_EXACT
    pair = lambda lo, hi: F.struct(lo.cast("double").alias("low"), hi.cast("double").alias("high"))
    return (
        F.when(num(span).isNotNull(), pair(num(span), num(span, 2))).when(num(least).isNotNull(), pair(num(least), F.lit(None)))
        .when(num(most).isNotNull(), pair(F.lit(0), num(most))).when(num(exact).isNotNull(), pair(num(exact) - 1, num(exact) + 1))
    )


def total_years(durations) -> Column:
    """Sum of the numbers before 'year' in an array of free-text durations."""
    n = F.transform(_c(durations), lambda d: F.coalesce(F.regexp_extract(d, r"(\d+\.?\d*)\s*years?", 1).try_cast("double"), F.lit(0.0)))
    return F.aggregate(n, F.lit(0.0), lambda a, v: a + v)


# Names of files, and texts of files


def file_stem(path) -> Column:
    """A path's last part without its last extension."""
    return F.regexp_replace(F.regexp_extract(_c(path), r"([^/]+)$", 1), r"(?<=.)\.[^.]*$", "")


def extension(path) -> Column:
    """What follows the last full stop of a path, in lower case; the whole name where there is none."""
    return F.lower(F.regexp_extract(_c(path), r"([^./]*)$", 1))


#: MIME types by extension.
MIME = {
    "csv": "text/csv",
    "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "htm": "text/html",
    "html": "text/html",
    "jpg": "image/jpeg",
    "json": "application/json",
    "pdf": "application/pdf",
    "png": "image/png",
    "txt": "text/plain",
    "xml": "text/xml",
    "zip": "application/zip",
}


def mime_type(path) -> Column:
    """By the extension; empty for one that is not known."""
    known = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit(""))


def clean_lines(x) -> Column:
    """A text's lines, stripped, without blank ones."""
    lines = F.transform(F.split(F.coalesce(_c(x), F.lit("")), r"\r\n|[\n\r\u000B\f\u001C-\u001E\u0085\u2028\u2029]"), lambda t: strip(t))
    return F.array_join(F.filter(lines, lambda t: t != ""), "\n")


#: Fixed value: a PDF with less text than this is taken for a scanned one.
LEAST_TEXT = 100


def looks_scanned(path, text) -> Column:
    return (mime_type(path) == MIME["pdf"]) & (F.length(strip(F.coalesce(_c(text), F.lit("")))) < LEAST_TEXT)


def temporary_id(path) -> Column:
    """A file's stem and eight hex digits of its path's digest: an id until a record has its own, the same in every run."""
    return F.concat(file_stem(path), F.lit("_"), F.substring(F.sha2(_c(path), 256), 1, 8))


#: What words are made of where whole words count: letters, digits, underscores, and the signs of names such as c++ and c#.
WORD = r"[\p{L}\p{N}_+#]+"


def spaced(x) -> Column:
    """A text's words in lower case, a space before and after each, so that a phrase's words are found in a row and as wholes."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_c(x), F.lit(""))), F.lit(WORD), F.lit(0))
    return F.concat(F.lit(" "), F.array_join(found, " "), F.lit(" "))


def has_phrase(text: Column, phrase: Column) -> Column:
    """Whether a text holds a phrase's words in a row, as whole words; a phrase without words is in none."""
    return F.contains(spaced(text), spaced(phrase)) & (spaced(phrase) != "  ")


def word_any(skill, note, strict: bool = False) -> Column:
    """The skill, or any word of it, is part of the note; with ``strict`` as whole words."""
    if strict:
        each = F.regexp_extract_all(F.lower(F.coalesce(_c(skill), F.lit(""))), F.lit(WORD), F.lit(0))
        text = spaced(note)
        return F.exists(each, lambda w: F.contains(text, F.concat(F.lit(" "), w, F.lit(" "))))
    low = F.lower(_c(note))
    return F.contains(low, F.lower(_c(skill))) | F.exists(words(F.lower(_c(skill))), lambda w: F.contains(low, w))
