"""Operator 10, secret scans: fixed patterns, and zstandard novelty for strings in a sensitive context.

A candidate is weighed by what it adds to the compressed size of the text around it. The compressor is primed with a
dictionary of common code and identifiers, so names that recur or are ordinary cost little; a string that stays nearly
incompressible is reported. Every candidate is weighed: the values next to a sensitive word, the values of assignments without
one, and the values of the base patterns, whose spans stay whatever their novelty. A value whose letter pairs are those of
the dictionary and the text around reads as a name, and must add more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import zstandard
from pyspark.sql import DataFrame

from .common import appended

#: The base patterns, with the least length that counts (fixed values). Order is the order of kinds.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "novel")

_assign = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
_access = re.compile(ACCESS)
_hex = re.compile(HEX.replace("+", "{%d,}" % LEAST["hex"]))  # runs are maximal, so shorter ones need no match
_hint = re.compile(r"key|secret|token|passw(?:or)?d|passphrase|pwd|auth|bearer|credential|private|signature|session|cookie|login", re.ASCII | re.IGNORECASE)
_name = re.compile(r"[\w.-]*+", re.ASCII)
#: What may stand between a name and its value: closing marks, an annotation before =, then any run of blanks, separators, opening marks and string prefixes.
_between = re.compile(
    r"""["'`)\]]*+(?:\s*+:\s*+[A-Za-z_][\w.\[\], |]*+(?==))?+(?:[\s:=<>(\[{,|"'`]|->|is\s|[bru]{1,2}(?=["'`]))++""",
    re.ASCII | re.IGNORECASE,
)
_value = re.compile(r"[A-Za-z0-9+/_=~-]{7,}+")
_piece = re.compile(r"[A-Za-z0-9+/_~-]{7,}+=*+")  # a value behind an inner =
_quoted = re.compile(r"""[^\s"'`<>]{7,}+(?=["'`])""")  # a value between quotes may hold other marks
_assigned = re.compile(r"""[:=]\s?["'`]?([A-Za-z0-9+/_=~-]{20,}+)""")  # of any name
_words = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_letters = re.compile(r"[a-z]{2,}")
_filler = re.compile(r"abcdefghijklmnopqrstuvwxyz|([a-z])\1{3,}")
_hints = ("key", "secret", "token", "passw", "passphrase", "pwd", "auth", "bearer", "credential", "private", "signature", "session", "cookie", "login")

#: Ordinary code and words that prime the compressor; their letter pairs are those of names.
IDENTIFIERS = """import export const function return class public private static void string number boolean undefined null true false
self.config settings.environment os.environ.get("API_KEY") getenv("SECRET_TOKEN") process.env.ACCESS_TOKEN access_token refresh_token
token_type token_count max_tokens tokenizer api_key_name secret_name secret_manager password_field password_hash password_reset
change_me_please your_api_key_here your_secret_here example_value placeholder XXXXXXXXXXXXXXXX 0000000000000000 1234567890 abcdefghijklmnopqrstuvwxyz
ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789abcdef https://www.example.com/index.html http://localhost:8080/api/v1/users Authorization: Bearer
Content-Type: application/json user_name user_id session_id request_id client_id client_secret private_key public_key BEGIN END
def __init__(self, *args, **kwargs): for item in items: if value is not None: raise ValueError print(result) SELECT FROM WHERE
January February March April May June July August September October November December 2020-01-01T00:00:00Z 127.0.0.1
performance management available knowledge through between different important information following together government development
question company problem service business community university education environment technology organization relationship everything
background keyboard workflow framework application authentication validation middleware handler request response exception timeout
directory temporary recursive synchronous callback dictionary parameter optional required supported maximum minimum average frequency
language product quick judge jump object subject expected experience example complex exactly equal quality query queue high right light enough
although voyage cycle physics symbol system analysis hypothesis rhythm hardware software network gateway whitelist upgrade downgrade checkpoint"""


@dataclass(frozen=True)
class NoveltyRules:
    """around: characters of surrounding text on each side; least: share of a candidate's own bytes that it must add to count, least_plain: the same for a value without a sensitive word, least_name: for one that reads as a name; pairs, words: a name has that share of ordinary letter pairs and that share of its letters and digits in words of three letters or more."""

    around: int = 512
    least: float = 0.45
    least_plain: float = 0.6
    least_name: float = 1.4
    pairs: float = 0.75
    words: float = 0.6


def base_spans(text: str) -> list[tuple[int, str, int, int]]:
    """(start, kind, end, where the value starts) of the base patterns, each kind leftmost and non-overlapping."""
    low = text.lower()
    found: list[tuple[int, str, int, int]] = []
    if any(k in low for k in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), "assign", m.end(), m.start(2)) for m in _assign.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end(), m.start()) for m in _access.finditer(text) if len(m[0]) >= LEAST["access"]]
    return found + [(m.start(), "hex", m.end(), m.start()) for m in _hex.finditer(text)]


def letter_pairs(text: str) -> set[str]:
    """Neighbouring letters within the words of text, in lower case; runs of one letter and of the alphabet are no words."""
    return {w[i : i + 2] for w in set(_letters.findall(_filler.sub(" ", text.lower()))) for i in range(len(w) - 1)}


class Novelty:
    """Marginal compressed size under the primed dictionary, and what reads as a name beside it."""

    def __init__(self, identifiers: str = IDENTIFIERS):
        primed = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=19, dict_data=primed, write_checksum=False, write_content_size=False)
        self.pairs = letter_pairs(identifiers)

    def share(self, before: str, candidate: str, after: str) -> float:
        """Bytes that the candidate adds to the compressed surroundings, over its own bytes."""
        around = (before + after).encode()
        whole = (before + after + candidate).encode()
        return (len(self.compressor.compress(whole)) - len(self.compressor.compress(around))) / len(candidate.encode())

    def is_name(self, before: str, candidate: str, after: str, rules: NoveltyRules) -> bool:
        """Words (also in camel case) of three letters or more fill the candidate, by letter pairs of the dictionary or the surroundings."""
        words = [w.lower() for w in _words.findall(candidate) if len(w) > 2]
        if sum(map(len, words)) < rules.words * sum(map(str.isalnum, candidate)):
            return False
        own = [w[i : i + 2] for w in words for i in range(len(w) - 1)]
        strange = [p for p in own if p not in self.pairs]
        if len(strange) > (1 - rules.pairs) * len(own):
            near = letter_pairs(before + " " + after)
            strange = [p for p in strange if p not in near]
        return len(strange) <= (1 - rules.pairs) * len(own)


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of each value next to a sensitive word, by that word.

    A value may hold sensitive words that have a value of their own, so the search goes on behind the word, not behind the
    value; what then starts within an earlier value ends at the next =, so a text costs time in proportion to its length.
    """
    at, last = 0, (-1, -1)
    while hint := _hint.search(text, at):
        at = _name.match(text, hint.end()).end()
        gap = _between.match(text, at)
        if gap is None:
            continue
        inner = gap.end() < last[1]
        quoted = None if inner or text[gap.end() - 1] not in "\"'`" else _quoted.match(text, gap.end())
        value = quoted or (_piece if inner else _value).match(text, gap.end())
        if value is not None and value.span() != last:
            yield value.span()
            last = last if inner else value.span()


def novel_spans(text: str, base: list[tuple[int, str, int, int]], novelty: Novelty, rules: NoveltyRules) -> list[tuple[int, str, int, float]]:
    """(start, "novel", end, share) of the candidates that lie in no base span and are nearly incompressible; one may reach beyond a base span."""
    low = text.lower()
    found = list(candidates(text)) if any(h in low for h in _hints) else []
    near = {start for start, _ in found}
    plain = [m.span(1) for m in _assigned.finditer(text)]
    out: list[tuple[int, str, int, float]] = []
    reached = -1
    for start, end in sorted(found + [x for x in plain if x[0] not in near]):
        if start < reached or any(a <= start and end <= b for a, _, b, _ in base):
            continue
        s, before, after = text[start:end], text[max(0, start - rules.around) : start], text[end : end + rules.around]
        share = novelty.share(before, s, after)
        least = rules.least if start in near else rules.least_plain
        if share >= least and novelty.is_name(before, s, after, rules):
            least = rules.least_name
        if share >= least:
            out.append((start, "novel", end, share))
            reached = end
    return out


def in_order(spans: list[tuple]) -> list[tuple]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1])))


def listed(spans: list[tuple]) -> str:
    return ",".join(f"{s[1]}:{s[0]}:{s[2]}" for s in in_order(spans))


def secret_scan(docs: DataFrame, rules: NoveltyRules = NoveltyRules(), identifiers: str = IDENTIFIERS, text: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """Add n_assign, n_access, n_hex, base_spans and spans (texts of kind:start:end in code points, end exclusive, by start and kind), and novelty (the share of its own bytes that each of spans adds, in the same order).

    Null and empty texts have no spans (empty strings, an empty array). Long texts are scanned whole. Repeated rows give
    repeated results, an empty table gives no rows; other columns (those named in carry, or all) pass through, and those
    named like the new ones are replaced.
    """

    def make():
        weigh = Novelty(identifiers)

        def one(t: str | None) -> tuple:
            if not t:
                return (0, 0, 0, "", "", [])
            base = base_spans(t)
            weighed = [(a, kind, b, weigh.share(t[max(0, v - rules.around) : v], t[v:b], t[b : b + rules.around])) for a, kind, b, v in base]
            every = in_order(weighed + novel_spans(t, base, weigh, rules))
            kinds = [s[1] for s in base]
            return (*(kinds.count(k) for k in KINDS[:3]), listed(base), listed(every), [s[3] for s in every])

        return lambda texts: list(zip(*map(one, texts), strict=True))

    return appended(docs, text, "n_assign long, n_access long, n_hex long, base_spans string, spans string, novelty array<double>", make, carry)
