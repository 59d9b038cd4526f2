"""Text functions as Column expressions; all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The Vietnamese and Latin letters that folding maps to plain ones.
FOLDED = "àáảãạăằắẳẵặâầấẩẫậäåèéẻẽẹêềếểễệëìíỉĩịîïòóỏõọôồốổỗộơờớởỡợöùúủũụưừứửữựûüỳýỷỹỵđçñ"
PLAIN = "aaaaaaaaaaaaaaaaaaaeeeeeeeeeeeeiiiiiiioooooooooooooooooouuuuuuuuuuuuuyyyyydcn"


def let(value: Column, use) -> Column:
    """use(value), with value made once for a row however often use names it, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def pieces(t: Column, n: int) -> Column:
    """The different substrings of n characters; t has at least as many."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substring(t, i, F.lit(n))))


def js_round(x: Column) -> Column:
    """Half rounds towards plus infinity."""
    return F.floor(x + 0.5)


def symbol_key(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "))


def fold(x: Column) -> Column:
    """Lower case without the diacritics of FOLDED and without combining marks, so that decomposed letters fold too."""
    return F.regexp_replace(F.translate(F.lower(x), FOLDED, PLAIN), r"\p{Mn}+", "")


def words(x: Column) -> Column:
    return F.filter(F.split(symbol_key(x), " "), lambda w: F.length(w) > 0)


def token_set(x: Column, least: int = 3) -> Column:
    """Different words of `least` characters or more."""
    return F.array_distinct(F.filter(words(x), lambda w: F.length(w) >= least))


def content_words(x: Column, stop: list[str]) -> Column:
    return F.array_except(token_set(x), F.array(*[F.lit(s) for s in stop]))


# Ending, letters of the shortest word that loses it, what takes its place, whether a doubled last letter is made single.
ENDINGS = (("ies", 6, "y", False), ("ing", 7, "", True), ("ied", 6, "y", False), ("ed", 6, "", True), ("es", 6, "", False), ("s", 5, "", False))


def _single_end(x: Column) -> Column:
    return F.regexp_replace(x, r"(.)\1$", "$1")


def stem(w: Column) -> Column:
    """A light English stemmer: plural and verb endings, doubled last letters; the first ending of ENDINGS that fits is cut."""
    out = w
    for ending, least, put, single in reversed(ENDINGS):
        bare = F.concat(F.substring(w, F.lit(1), F.length(w) - len(ending)), F.lit(put))
        out = F.when(w.endswith(ending) & (F.length(w) >= least), _single_end(bare) if single else bare).otherwise(out)
    return out


def excerpt(x: Column, most: int) -> Column:
    """x without runs of white space, cut to `most` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def word_count(x: Column) -> Column:
    return F.size(F.filter(F.split(x, r"\s+"), lambda w: F.length(w) > 0))


def token_estimate(x: Column) -> Column:
    """Tokens as four ASCII or 2.6 other characters each, rounded up."""
    ascii_n = F.length(F.regexp_replace(x, r"[^\x00-\x7F]", ""))
    return F.ceil(ascii_n / 4 + (F.length(x) - ascii_n) / 2.6)


def ranges(x: Column, pattern: str) -> Column:
    """array<struct<start, end>> of a pattern's matches, leftmost and apart, in characters from 0."""
    def at(gaps, found):
        size = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda n, p: n + F.length(p))
        start = lambda i: size(F.slice(gaps, 1, i + 1)) + size(F.slice(found, 1, i))
        return F.transform(found, lambda f, i: F.struct(start(i).alias("start"), (start(i) + F.length(f)).alias("end")))

    return let(F.split(x, pattern, -1), lambda gaps: let(F.regexp_extract_all(x, F.lit(pattern), 0), lambda found: at(gaps, found)))


def sentences(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, r"(?<=[.!?])\s+|\n+"), F.trim), lambda s: F.length(s) > 0)


# What tells a page number in a running header or footer, and what takes its place.
PAGE_MARKS = (
    (r"(?<![\p{L}\p{N}_])(page|trang|p|pp)\.?\s*[0-9]+(?:\s*(?:of|/)\s*[0-9]+)?(?![\p{L}\p{N}_])", "$1 #"),
    (r"^[0-9]+$", "#"), (r"\s*[0-9]+\s*$", " #"), (r"^\s*[0-9]+\s*", "# "), (r"[^\p{L}\p{N}_\s#]", ""),
)


def line_key(x: Column) -> Column:
    """A line without punctuation, whatever the page number in it or at its ends is; other numbers stay."""
    out = F.trim(F.lower(x))
    for mark, put in PAGE_MARKS:
        out = F.regexp_replace(out, mark, put)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def normal_url(x: Column) -> Column:
    """An address in lower case without http or https, www. and one last slash; a fragment stays."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), r"^(https?://)?(www\.)?", ""), r"/$", "")


def strip_markup(x: Column) -> Column:
    """Text without tags and the five entities."""
    out = F.regexp_replace(x, r"<[^>]*>", " ")
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


# Marks of a claim's markup, and what takes their place.
CLAIM_MARKS = (
    (r"\[\?\]", ""), (r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"^\s*(?:#{1,6}|>|[-+*]|[0-9]+[.)])\s+", ""),
    (r"[*_~`]+", ""), (r"<[^>]+>", " "), (r"\s+([,.;:!?])", "$1"), (r"\s+", " "),
)


def clean_claim(x: Column) -> Column:
    """A claim without markdown, links, tags, a leading bullet or number and open citation marks."""
    for pattern, to in CLAIM_MARKS:
        x = F.regexp_replace(x, pattern, to)
    return F.trim(x)


def isbn10(x: Column) -> Column:
    """Whether ten characters are an ISBN with the right check digit."""
    d = F.split(F.regexp_replace(x, "[ -]", ""), "")
    value = F.transform(d, lambda c: F.when(c == "X", F.lit(10)).otherwise(c.try_cast("int")))
    total = F.aggregate(F.transform(value, lambda v, i: v * (F.lit(10) - i)), F.lit(0), lambda a, v: a + v)
    return F.coalesce(F.regexp_replace(x, "[ -]", "").rlike(r"^[0-9]{9}[0-9X]$") & (total % 11 == 0), F.lit(False))


def isbn13(x: Column) -> Column:
    d = F.split(F.regexp_replace(x, "[ -]", ""), "")
    value = F.transform(d, lambda c, i: c.try_cast("int") * (1 + 2 * (i % 2)))
    total = F.aggregate(value, F.lit(0), lambda a, v: a + v)
    return F.coalesce(F.regexp_replace(x, "[ -]", "").rlike(r"^97[89][0-9]{10}$") & (total % 10 == 0), F.lit(False))


def dois(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit(r"(10\.[0-9]{4,9}/[^\s\"<>]+)"), 1))


def protected_tokens(x: Column) -> Column:
    """Tokens a translation must keep: DOIs, citations, statistics, percentages, numbers."""
    found = [F.regexp_extract_all(x, F.lit(p), 0) for p in (r"10\.[0-9]{4,9}/[^\s]+", r"\[[0-9, ]+\]", r"p\s*[<=>]\s*[0-9.]+", r"[0-9]+(?:\.[0-9]+)?%", r"[0-9]+(?:\.[0-9]+)?")]
    return F.array_distinct(F.concat(*found))


def tokens_kept(source: Column, target: Column) -> Column:
    return F.forall(protected_tokens(source), lambda t: F.contains(target, t))


def overlap(a: Column, b: Column) -> Column:
    """Common elements over the smaller set; 0 with an empty one."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def capped_overlap(a: Column, b: Column, cap: int = 12) -> Column:
    return let(b, lambda b: F.when(F.size(b) > 0, F.size(F.array_intersect(a, b)) / F.least(F.lit(cap), F.size(b))).otherwise(0.0))


def coverage(needle: Column, hay: Column) -> Column:
    return F.when(F.size(needle) > 0, F.size(F.array_intersect(needle, hay)) / F.size(needle)).otherwise(0.0)


def trigrams(x: Column) -> Column:
    """Different character trigrams of the folded text."""
    return let(F.regexp_replace(fold(x), r"\s+", " "), lambda t: F.when(F.length(t) < 3, F.array(t)).otherwise(pieces(t, 3)))


def content_key(x: Column, prefix: str = "") -> Column:
    """A short stable key of a normalized text."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(symbol_key(x), 256), 1, 32))


# What may not reach a log.
SECRET_KEYS = (
    "password|passwordHash|currentPassword|newPassword|confirmPassword|otp|otpCode|verificationCode|accessToken|refreshToken|token|apiKey|apiSecret|"
    "secret|credential|encryptionKey|plaintext|ciphertext|authTag|iv|content|message|messageContent|prompt|rawBody"
)
BEARER = r"(?i)(?<![A-Za-z0-9_])Bearer\s+[A-Za-z0-9._~+/=-]+"
QUERY_SECRET = r"(?i)([?&](?:token|otp|code|password|secret|key|authorization)=)[^&#\s]*"
JSON_SECRET = rf'(?i)("(?:{SECRET_KEYS})"\s*:\s*)"[^"]*"'
SECRET_NAME = rf"(?i)^(?:authorization|cookie|set-cookie|{SECRET_KEYS})$"


def redacted(x: Column) -> Column:
    """Text without bearer tokens, secret parameters and fields and, where codes are spoken of, six-digit codes."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, BEARER, "Bearer [REDACTED]"), QUERY_SECRET, "$1[REDACTED]"), JSON_SECRET, '$1"[REDACTED]"')
    codes = F.regexp_replace(out, r"(?<![A-Za-z0-9_])[0-9]{6}(?![A-Za-z0-9_])", "[REDACTED]")
    return F.when(out.rlike(r"(?i)(?<![A-Za-z0-9_])(otp|verification code)(?![A-Za-z0-9_])"), codes).otherwise(out)


def redacted_values(m: Column) -> Column:
    """A map of texts without the values of secret keys, and with the others redacted."""
    return F.transform_values(m, lambda k, v: F.when(k.rlike(SECRET_NAME), "[REDACTED]").otherwise(redacted(v)))
