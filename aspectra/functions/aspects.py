"""Lexicon patterns and aspect detection as native regex expressions.

Python's ``re`` treats ``\\b``, ``\\w`` and IGNORECASE as Unicode-aware; in
Java that needs ``(?iU)`` (UNICODE_CHARACTER_CLASS implies Unicode case).
For engines whose ``\\b``/``\\w`` are ASCII (RE2, used by DuckDB), an explicit
letter/digit class form is generated from the same token list.

Detection scans each text once for all aspects.  A token made only of word
characters (and ``\\w*``/``\\w+``) between ``\\b`` ... ``\\b`` always matches a
whole word, so one ``regexp_extract_all`` with the union of every aspect's
word tokens finds exactly the words any aspect can match; each aspect then
tests only those short words.  Alternations are factored by common prefix
(a trie), so a word start tries one branch per distinct next character, and a
lookahead class of the tokens' first characters rejects most word starts at once.
Tokens with other characters (e.g. ``R\\$``) can match a different span, so
they keep their own per-aspect ``rlike``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aspectra.schema import ASPECTS, NARROW_DEFAULT

_WORD_RE2 = r"[\p{L}\p{N}_]"


def _atoms(token: str) -> list[str]:
    """Split a token into atoms: one character, an escape (``\\$``), or a class with quantifier (``\\w*``)."""
    atoms, i = [], 0
    while i < len(token):
        if token[i] == "\\":
            a, i = token[i:i + 2], i + 2
            if i < len(token) and token[i] in "*+?":
                a, i = a + token[i], i + 1
            atoms.append(a)
        else:
            atoms.append(token[i])
            i += 1
    return atoms


def is_word_token(token: str) -> bool:
    """True if every atom is a word character or ``\\w*`` / ``\\w+`` (the token then matches whole words)."""
    return all((len(a) == 1 and (a.isalnum() or a == "_")) or a in (r"\w*", r"\w+") for a in _atoms(token))


def trie_pattern(tokens: list[str]) -> str:
    """The alternation of ``tokens`` factored by common prefix (same matches as ``a|b|...``)."""
    root: dict = {}
    for t in tokens:
        node = root
        for a in _atoms(t):
            # share branches across case (the pattern is case-insensitive); keep characters whose
            # lower case is not a single character (e.g. U+0130) as written
            key = a.lower() if len(a) == 1 and len(a.lower()) == 1 else a
            node = node.setdefault(key, {})
        node[""] = {}

    def emit(node: dict) -> str:
        alts = [k + emit(node[k]) if k else "" for k in sorted(node)]
        return alts[0] if len(alts) == 1 else "(?:" + "|".join(alts) + ")"

    return emit(root) if tokens else "(?!)"


def _first_char_guard(tokens: list[str]) -> str:
    """``(?=[...])`` of the tokens' first characters, or '' if a token may start with any word character.

    One character-class test rejects most word starts before the alternation is tried.
    """
    firsts = set()
    for t in tokens:
        a = _atoms(t)[0] if t else ""
        if len(a) != 1:
            return ""
        firsts.update({a, a.lower()} if len(a.lower()) == 1 else {a})
    return "(?=[" + "".join(sorted(firsts)) + "])"


def java_pattern(tokens: list[str]) -> str:
    """``\\b(tok1|tok2|...)\\b`` with Unicode-aware flags for Spark ``rlike``."""
    return r"(?iU)\b(" + "|".join(tokens) + r")\b"


def re2_pattern(tokens: list[str]) -> str:
    """Equivalent pattern for RE2 engines (word chars spelt as a Unicode class)."""
    body = "|".join(t.replace(r"\w", _WORD_RE2) for t in tokens)
    return rf"(?i)(^|[^\p{{L}}\p{{N}}_])({body})($|[^\p{{L}}\p{{N}}_])"


def aspect_flags(text, lexicon: dict, aspects=None) -> Column:
    """One struct column with a boolean field per aspect (same as ``rlike(java_pattern(tokens))``).

    The text is scanned once: the matched words are bound as a lambda argument
    and every aspect tests those words.  Null text gives false everywhere.
    """
    c = F.col(text) if isinstance(text, str) else text
    aspects = aspects or [a for a in ASPECTS if a in lexicon]
    words_of = {a: [t for t in lexicon[a] if is_word_token(t)] for a in aspects}
    other_of = {a: [t for t in lexicon[a] if not is_word_token(t)] for a in aspects}
    union = [t for a in aspects for t in words_of[a]]

    def matches(pattern: str):
        return lambda w: w.rlike(pattern)  # one-argument lambda (Spark reads the arity)

    def per_aspect(ws):
        fields = []
        for a in aspects:
            hit = (F.exists(ws, matches(r"(?iU)^" + trie_pattern(words_of[a]) + "$")) if words_of[a]
                   else F.lit(False))
            if other_of[a]:
                hit = hit | c.rlike(java_pattern(other_of[a]))
            fields.append(F.coalesce(hit, F.lit(False)).alias(a))
        return F.struct(*fields)

    found = (F.regexp_extract_all(c, F.lit(r"(?iU)\b" + _first_char_guard(union) + trie_pattern(union) + r"\b"), 0)
             if union else F.array().cast("array<string>"))
    return F.get(F.transform(F.array(found), per_aspect), 0)


def aspect_hits(text, lexicon: dict, aspects=None) -> dict[str, Column]:
    """Per-aspect boolean columns, fields of one :func:`aspect_flags` struct.

    In a projection or aggregate Spark evaluates the shared struct once however
    many fields are used; inside a higher-order function bind it first (as
    :func:`detect_aspects` does).
    """
    aspects = aspects or [a for a in ASPECTS if a in lexicon]
    flags = aspect_flags(text, lexicon, aspects)
    return {a: flags[a] for a in aspects}


def detect_aspects(text, lexicon: dict, aspects=None, default=None) -> Column:
    """Array of matching aspect names in lexicon order.

    ``default`` (e.g. ``("produto",)``) replaces an empty result (X2).  The
    flag struct is bound once (lambda argument), so the text is scanned once.
    """
    aspects = aspects or [a for a in ASPECTS if a in lexicon]
    dflt = F.array(*[F.lit(d) for d in default]) if default else None

    def names(flags):
        arr = F.filter(F.array(*[F.when(flags[a], F.lit(a)) for a in aspects]), lambda x: x.isNotNull())
        return F.when(F.size(arr) == 0, dflt).otherwise(arr) if default else arr

    return F.get(F.transform(F.array(aspect_flags(text, lexicon, aspects)), names), 0)


def detect_aspects_narrow(text, lexicon: dict) -> Column:
    return detect_aspects(text, lexicon, default=NARROW_DEFAULT)


def aspect_flag(aspects_col, aspect: str) -> Column:
    """``tem_<aspect>`` membership flag."""
    c = F.col(aspects_col) if isinstance(aspects_col, str) else aspects_col
    return F.array_contains(c, F.lit(aspect))
