"""SQL of the contact queries. It has no back-references, so repeats and steps are told by lists of characters."""

from __future__ import annotations

from ..functions import contact


def _in(expr: str, words: list[str]) -> str:
    return f"{expr} IN ({', '.join(repr(w) for w in words)})"


def _ladder(*rules: tuple) -> str:
    """Reason and score, as ``reason|score``, of the first rule that holds."""
    return f"CASE {' '.join(f'''WHEN {r[0]} THEN '{r[1]}|{r[2] if len(r) > 2 else 0.2}' ''' for r in rules)} ELSE 'ok|1.0' END"


def _chars(x: str) -> str:
    return f"list_distinct(string_split({x}, ''))"


def _one_char(x: str) -> str:
    return f"(length({x}) >= 2 AND len({_chars(x)}) = 1)"


def _steps(x: str) -> str:
    """Distinct differences between the codes of neighbouring characters."""
    return f"list_distinct(list_transform(range(2, length({x}) + 1), lambda i: unicode(substr({x}, i, 1)) - unicode(substr({x}, i - 1, 1))))"


def _tiled(x: str) -> str:
    return f"(len(list_filter([1, 2, 3], lambda k: length({x}) >= 2 * k AND {x} = repeat(left({x}, k), length({x}) // k))) > 0)"


def _run(x: str) -> str:
    return f"list_max(list_transform(regexp_split_to_array(lower({x}), '[aeiouy]'), lambda p: length(p)))"


def _ascii(x: str) -> str:
    return f"regexp_full_match({x}, '[A-Za-z]+')"


def _vowel(x: str) -> str:
    return f"regexp_matches({x}, '[aeiouAEIOU]')"


def _gibberish(x: str) -> str:
    return f"({_ascii(x)} AND ({_run(x)} >= 5 OR (length({x}) >= 6 AND NOT {_vowel(x)})))"


NAME = _ladder(
    (r"NOT regexp_full_match(name_s, '\p{L}[\p{L}\s''.-]{1,49}')", "format"),
    ("length(letters) < 2", "too_short"),
    (_one_char("letters"), "repeated_chars"),
    (f"length(compact) >= 3 AND {_steps('low')} IN ([1], [-1])", "sequential"),
    (_tiled("low"), "repeated_syllables"),
    (_in("low", contact.KEYBOARD_WALKS), "keyboard_walk"),
    (f"{_ascii('letters')} AND NOT {_vowel('letters')}", "no_vowels"),
    (f"len(list_filter(parts, lambda t: {_gibberish('t')})) > 0", "gibberish_token"),
    (f"length(compact) >= 5 AND latin <> '' AND len({_chars('latin')}) / length(latin) < 0.3", "low_entropy", 0.35),
    (f"{_ascii('compact')} AND regexp_matches(low, '{contact.RARE_BIGRAMS}')", "implausible_bigram", 0.3),
)
EMAIL = _ladder(
    (r"NOT regexp_full_match(email_s, '[^\s@]+@[^\s@]+')", "syntax"),
    (r"NOT regexp_full_match(domain, '[^.\s]+(\.[^.\s]+)+') OR NOT regexp_matches(domain, '\.[A-Za-z]{2,}$')", "domain_format"),
    (_in("lower(domain)", contact.DISPOSABLE_DOMAINS), "disposable_domain"),
    (_in("local", contact.PLACEHOLDER_LOCALS), "placeholder_local"),
    (_gibberish("local"), "gibberish_local"),
    (f"{_ascii('local')} AND length(local) >= 3 AND NOT {_vowel('local')}", "no_vowel_local"),
    (_in("local", contact.KEY_FRAGMENTS), "keyboard_local"),
    (_in("lower(split_part(domain, '.', 1))", contact.KEY_FRAGMENTS), "keyboard_domain"),
)
PHONE = _ladder(
    ("NOT regexp_full_match(digits, '[0-9]{8,15}') OR (domestic AND (length(digits) > 12 OR (length(digits) = 11 AND digits[1] <> '0') OR (length(digits) = 12 AND left(digits, 2) <> '91')))", "impossible_length"),
    ("domestic AND length(digits) = 10 AND digits[1] NOT IN ('6', '7', '8', '9')", "invalid_prefix"),
    (_one_char("digits"), "repeated_digits"),
    (f"list_distinct(list_transform({_steps('digits')}, lambda d: (d + 10) % 10)) IN ([1], [9])", "sequential_digits"),
    ("left(digits, length(digits) - 2) = right(digits, length(digits) - 2)", "alternating_pattern"),
)
MESSAGE = _ladder(
    ("length(message_s) < 15 OR length(regexp_replace(message_s, '[^A-Za-z]', '', 'g')) < 10 OR len(words) < 3", "too_short"),
    (_one_char(r"regexp_replace(message_s, '\s', '', 'g')"), "repeated_chars"),
    (r"regexp_matches(message_s, '[^\p{L}\p{N}\s]{4,}')", "punctuation_spam"),
    ("len(words) >= 5 AND list_max(map_values(list_aggregate(list_transform(words, lambda w: lower(w)), 'histogram'))) / len(words) > 0.4", "repeated_tokens"),
    (f"len(plain) >= 3 AND 2 * len(list_filter(plain, lambda t: {_run('t')} >= 4)) >= len(plain)", "gibberish"),
    ("len(list_filter(tokens, lambda t: regexp_matches(t, '[a-z][0-9]+[a-z]'))) > 0", "gibberish", 0.3),
    (f"len(words) >= 5 AND len(list_filter(plain, lambda t: {_in('t', contact.FUNCTION_WORDS)})) = 0", "no_natural_language", 0.3),
)

FIELDS = ("name", "email", "phone", "message")


def scored(rows: str) -> str:
    """Common table expressions from ``rows``, a query of id and the four fields, up to ``f`` with their marks as ``reason|score``."""
    marks = ", ".join(f"{ladder} AS {k}_raw" for k, ladder in zip(FIELDS, (NAME, EMAIL, PHONE, MESSAGE), strict=True))
    failing = " + ".join(f"CAST(CAST(split_part({k}_raw, '|', 2) AS DOUBLE) < 0.5 AS INT)" for k in FIELDS)
    final = ", ".join(f"CASE WHEN failing >= 2 AND CAST(split_part({k}_raw, '|', 2) AS DOUBLE) >= 0.5 THEN 'composite_distrust|0.4' ELSE {k}_raw END AS {k}_mark" for k in FIELDS)
    return rf"""rows AS ({rows}),
    trimmed AS (SELECT *, {', '.join(f"trim(coalesce({k}, '')) AS {k}_s" for k in FIELDS)} FROM rows),
    cut AS (SELECT *, regexp_replace(name_s, '[^\p{{L}}]', '', 'g') AS letters, regexp_replace(name_s, '[\s''.-]', '', 'g') AS compact,
        list_filter(regexp_split_to_array(name_s, '[\s''.-]+'), lambda t: t <> '') AS parts,
        lower(regexp_extract(email_s, '^([^\s@]+)@([^\s@]+)$', 1)) AS local, regexp_extract(email_s, '^([^\s@]+)@([^\s@]+)$', 2) AS domain,
        regexp_replace(regexp_replace(phone_s, '[\s()\-.]', '', 'g'), '^\+', '') AS digits, left(phone_s, 1) <> '+' AS domestic,
        list_filter(regexp_split_to_array(message_s, '\s+'), lambda w: w <> '') AS words FROM trimmed),
    fine AS (SELECT *, lower(compact) AS low, regexp_replace(lower(compact), '[^a-z]', '', 'g') AS latin, list_transform(words, lambda w: regexp_replace(lower(w), '[^a-z0-9]', '', 'g')) AS tokens FROM cut),
    p AS (SELECT *, list_filter(tokens, lambda t: regexp_full_match(t, '[a-z]+')) AS plain FROM fine),
    r AS (SELECT *, {marks} FROM p), c AS (SELECT *, {failing} AS failing FROM r), f AS (SELECT *, {final} FROM c)"""


def _picked(values: tuple[str, ...], key: str = "c_custkey") -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], CAST({key} % {len(values)} AS INT) + 1)"


#: The contacts that the queries judge, made from keys and from what conversations say first.
ROWS = f"""SELECT c_custkey AS id, {_picked(("Asha Rao", "aaaa", "abcdef", "qwerty", "José Núñez", "xkcd brtfgh", "Jo", "ababab", "Majd", "bcdfg"))} AS name,
        concat({_picked(("jo", "test", "bcdfgh", "asd", "maria.lopez", "xyz1"))}, '@', {_picked(("firm.com", "mailinator.com", "qwe.com", "nodot", "uni.example.org"))}) AS email,
        {_picked(("9876501234", "1234567890", "+1111111111", "12345678", "+49 (30) 1234-5670", "919876501234", "12121212", "98765432109", "5"))} AS phone,
        CASE c_custkey % 3 WHEN 0 THEN 'hello' WHEN 1 THEN 'We would like to see the report about your company please' ELSE coalesce(said, '') END AS message
        FROM customer LEFT JOIN (SELECT conv_id, min({{'turn': turn, 'text': text}}).text AS said FROM conversations WHERE role = 'user' GROUP BY conv_id) ON c_custkey = conv_id"""

_score = "CAST(split_part({}_mark, '|', 2) AS DOUBLE)".format
_reason = "split_part({}_mark, '|', 1)".format

SCORES = f"""WITH {scored(ROWS)}
    SELECT id, {', '.join(f'{_score(k)} AS {k}_score, {_reason(k)} AS {k}_reason' for k in FIELDS)}, round(({' + '.join(map(_score, FIELDS))}) / 4, 4) AS validation_score FROM f"""

LOG = f"""WITH {scored(ROWS)}
    {' UNION ALL '.join(f"SELECT id, '{k}' AS field, left({k}, 512) AS value, {_score(k)} AS score, {_reason(k)} AS reason FROM f WHERE {_score(k)} < 0.5" for k in FIELDS)}"""
