"""Rule ladders that score contact fields: the first rule that holds gives score and reason.

A field is (score, reason); 0.5 and more passes. Rules on letters judge ASCII words only, so
names in other scripts pass.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PASS = 0.5

# Word lists of the rules.
KEYBOARD_WALKS = "qwerty qwertyuiop asdf asdfgh asdfghjkl zxcv zxcvbn poiuy lkjh mnbv qazwsx wasd".split()
PLACEHOLDER_LOCALS = "test fake fakeemail asdf qwerty abc abc123 admin example demo sample noreply nomail".split()
DISPOSABLE_DOMAINS = "mailinator.com guerrillamail.com tempmail.com temp-mail.org 10minutemail.com yopmail.com trashmail.com sharklasers.com getnada.com dispostable.com".split()
KEY_FRAGMENTS = "qwe wer ert rty tyu yui uio iop asd sdf dfg fgh ghj hjk jkl zxc xcv cvb vbn bnm".split()
RARE_BIGRAMS = "jd|jk|jq|jx|jz|qd|qk|qx|qz|vq|wq|xj|xq|zx|xv|fq|pq|bq|gq|hq|kq|mq|nq"
FUNCTION_WORDS = (
    "the a an to of in on for and or is are am be we i you it my our your me us this that with about please would like want need can could have has do does will more info information demo help hi hello thanks thank"
).split()


def _ladder(*rules: tuple[Column, str, float]) -> Column:
    out = F.struct(F.lit(1.0).alias("score"), F.lit("ok").alias("reason"))
    for broken, reason, score in reversed(rules):
        out = F.when(broken, F.struct(F.lit(score).alias("score"), F.lit(reason).alias("reason"))).otherwise(out)
    return out


def _rules(*rules: tuple) -> tuple:
    return tuple((r[0], r[1], r[2] if len(r) > 2 else 0.2) for r in rules)


def one_char(s: Column) -> Column:
    return s.rlike("^(.)\\1+$")


def ascii_word(s: Column) -> Column:
    return s.rlike("^[A-Za-z]+$")


def has_vowel(s: Column) -> Column:
    return s.rlike("[aeiouAEIOU]")


def _steps(s: Column) -> Column:
    """Differences between the codes of neighbouring characters."""
    return F.transform(F.sequence(F.lit(2), F.greatest(F.length(s), F.lit(2))), lambda i: F.ascii(F.substr(s, i, F.lit(1))) - F.ascii(F.substr(s, i - 1, F.lit(1))))


def consecutive(s: Column) -> Column:
    steps = _steps(F.lower(s))
    return (F.length(s) >= 3) & (F.forall(steps, lambda d: d == 1) | F.forall(steps, lambda d: d == -1))


def tiled(s: Column) -> Column:
    """A unit of one to three characters fills the whole string."""
    return F.lower(s).rlike("^(.{1,3}?)\\1+$")


def consonant_run(s: Column) -> Column:
    """Longest run without a, e, i, o, u or y."""
    return F.array_max(F.transform(F.split(F.lower(s), "[aeiouy]"), lambda p: F.length(p)))


def diversity(s: Column) -> Column:
    letters = F.regexp_replace(F.lower(s), "[^a-z]", "")
    n = F.length(letters)
    return F.when(n == 0, 1.0).otherwise(F.size(F.array_distinct(F.filter(F.split(letters, ""), lambda c: c != ""))) / n)


def gibberish(s: Column) -> Column:
    return ascii_word(s) & ((consonant_run(s) >= 5) | ((F.length(s) >= 6) & ~has_vowel(s)))


def score_name(v: Column) -> Column:
    s = F.trim(F.coalesce(v, F.lit("")))
    letters = F.regexp_replace(s, "[^\\p{L}]", "")
    compact = F.regexp_replace(s, "[\\s'.-]", "")
    parts = F.filter(F.split(s, "[\\s'.-]+"), lambda t: t != "")
    return _ladder(
        *_rules(
            (~s.rlike("^\\p{L}[\\p{L}\\s'.-]{1,49}$"), "format"),
            (F.length(letters) < 2, "too_short"),
            (one_char(letters), "repeated_chars"),
            (consecutive(compact), "sequential"),
            (tiled(compact), "repeated_syllables"),
            (F.lower(compact).isin(KEYBOARD_WALKS), "keyboard_walk"),
            (ascii_word(letters) & ~has_vowel(letters), "no_vowels"),
            (F.exists(parts, gibberish), "gibberish_token"),
            ((diversity(compact) < 0.3) & (F.length(compact) >= 5), "low_entropy", 0.35),
            (ascii_word(compact) & F.lower(compact).rlike(RARE_BIGRAMS), "implausible_bigram", 0.3),
        )
    )


def score_email(v: Column) -> Column:
    s = F.trim(F.coalesce(v, F.lit("")))
    shape = "^([^\\s@]+)@([^\\s@]+)$"
    local, domain = F.lower(F.regexp_extract(s, shape, 1)), F.regexp_extract(s, shape, 2)
    base = F.lower(F.split_part(domain, F.lit("."), F.lit(1)))
    return _ladder(
        *_rules(
            (~s.rlike(shape), "syntax"),
            (~domain.rlike("^[^.\\s]+(\\.[^.\\s]+)+$") | ~domain.rlike("\\.[A-Za-z]{2,}$"), "domain_format"),
            (F.lower(domain).isin(DISPOSABLE_DOMAINS), "disposable_domain"),
            (local.isin(PLACEHOLDER_LOCALS), "placeholder_local"),
            (gibberish(local), "gibberish_local"),
            (ascii_word(local) & (F.length(local) >= 3) & ~has_vowel(local), "no_vowel_local"),
            (local.isin(KEY_FRAGMENTS), "keyboard_local"),
            (base.isin(KEY_FRAGMENTS), "keyboard_domain"),
        )
    )


def score_phone(v: Column) -> Column:
    s = F.trim(F.coalesce(v, F.lit("")))
    digits = F.regexp_replace(F.regexp_replace(s, "[\\s()\\-.]", ""), "^\\+", "")
    n = F.length(digits)
    domestic = ~s.startswith("+")
    length = (n > 12) | ((n == 11) & ~digits.startswith("0")) | ((n == 12) & ~digits.startswith("91"))
    steps = F.transform(_steps(digits), lambda d: F.pmod(d, F.lit(10)))
    return _ladder(
        *_rules(
            (~digits.rlike("^[0-9]{8,15}$") | (domestic & length), "impossible_length"),
            (domestic & (n == 10) & ~digits.rlike("^[6-9]"), "invalid_prefix"),
            (one_char(digits), "repeated_digits"),
            (F.forall(steps, lambda d: d == 1) | F.forall(steps, lambda d: d == 9), "sequential_digits"),
            (digits.rlike("^(..)\\1+$") | digits.rlike("^((.).)\\1*\\2$"), "alternating_pattern"),
        )
    )


def score_message(v: Column) -> Column:
    s = F.trim(F.coalesce(v, F.lit("")))
    words = F.filter(F.split(s, "\\s+"), lambda w: w != "")
    n = F.size(words)
    lowered = F.transform(words, lambda w: F.lower(w))
    # The longest stretch of equal words in sorted order is the largest count.
    text = F.concat(F.lit(" "), F.array_join(F.array_sort(lowered), "  "), F.lit(" "))
    most = F.array_max(F.transform(F.array_distinct(lowered), lambda w: (F.length(text) - F.length(F.replace(text, F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))) / (F.length(w) + 2)))
    tokens = F.transform(words, lambda w: F.regexp_replace(F.lower(w), "[^a-z0-9]", ""))
    plain = F.filter(tokens, lambda t: t.rlike("^[a-z]+$"))
    mash = F.size(F.filter(plain, lambda t: consonant_run(t) >= 4))
    short = (F.length(s) < 15) | (F.length(F.regexp_replace(s, "[^A-Za-z]", "")) < 10) | (n < 3)
    return _ladder(
        *_rules(
            (short, "too_short"),
            (one_char(F.regexp_replace(s, "\\s", "")), "repeated_chars"),
            (s.rlike("[^\\p{L}\\p{N}\\s]{4,}"), "punctuation_spam"),
            ((n >= 5) & (most / n > 0.4), "repeated_tokens"),
            ((F.size(plain) >= 3) & (mash * 2 >= F.size(plain)), "gibberish"),
            (F.exists(tokens, lambda t: t.rlike("[a-z][0-9]+[a-z]")), "gibberish", 0.3),
            ((n >= 5) & ~F.exists(plain, lambda t: t.isin(FUNCTION_WORDS)), "no_natural_language", 0.3),
        )
    )


def distrust(scores: dict[str, Column]) -> dict[str, Column]:
    """With two failing fields or more, those that passed are no longer trusted."""
    failures = sum((c["score"] < PASS).cast("int") for c in scores.values())
    low = F.struct(F.lit(0.4).alias("score"), F.lit("composite_distrust").alias("reason"))
    return {k: F.when((failures >= 2) & (c["score"] >= PASS), low).otherwise(c) for k, c in scores.items()}


# What a form says of a failing field.
MESSAGES = {
    "name": "Please enter your full name.\nThe current name appears incomplete or invalid.",
    "email": "Please enter a valid email address.\nThis email doesn't look deliverable.",
    "phone": "Please enter a valid phone number.\nThis number doesn't look real.",
    "message": "Please describe your enquiry in natural language.\nThe current message appears to contain random text.",
}


def field_message(field: str, check: Column) -> Column:
    """The form's message for a field below the pass mark, else null."""
    return F.when(check["score"] < PASS, MESSAGES[field])


def form_errors(checks: dict[str, Column]) -> Column:
    """Map of failing fields to messages."""
    every = F.map_from_arrays(F.array(*map(F.lit, checks)), F.array(*(field_message(k, c) for k, c in checks.items())))
    return F.map_filter(every, lambda _, v: v.isNotNull())
