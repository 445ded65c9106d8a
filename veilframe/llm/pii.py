r"""Personal data: rules for the plain forms, and a character tagger that adds what they miss.

The rules find e-mail, IP, card and phone spans.  A bidirectional LSTM with a CRF, trained in numpy on made-up text with
labelled spans, adds other spellings (obfuscated e-mail, oddly spaced numbers) and secrets.  It reads whole
texts in windows of ``TIME`` characters that overlap by half.  Scores of overlapping windows are blended, the nearer
to a window's middle the heavier, and a Viterbi path settles them globally.  A found span
must also fit its kind (digit counts, Luhn, parts) and overlap no rule span.  No text fits a kind that has neither
a digit, nor an at-sign, plain or bracketed, nor 16 characters after an equals sign or colon; documents without any need not be tagged.

Defined results: a null or empty text has no spans; a null id is kept; each repeated row is judged alike; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, id_text
from .char_tagger import CharTagger, inputs

RULE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*RULE_KINDS, "secret")
#: characters of a tagger window
TIME = 64
#: training: batches of made-up windows, and windows in each
BATCHES, ROWS = 340, 48

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, which can only match from where a run of digits starts: linear in long runs
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    """What ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`` finds, in linear time: each at-sign decides alone."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
        floor = domain.end() if domain else at + 1
        at = text.find("@", floor)
    return out


def _ip_ok(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-4:] if p.lstrip("0") else "0") <= 255 for p in text.split("."))


def rule_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the rules in order of start, then kind."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _ip_ok(m[0])]
        for m in _CARD.finditer(text):
            d = _digits(m[0]) if m.end() - m.start() >= 12 else ""
            if 12 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
        out.sort(key=lambda s: (s[1], RULE_KINDS.index(s[0])))
    return out


#: what stands before a value that is assigned to a name for secrets
_ASSIGNED = re.compile(r"(?:secret|token|key|passw(?:or)?d|passphrase|pwd|auth|credentials?)[\"'`]?\s?[=:]\s?[\"'`]?\Z", re.IGNORECASE)
_AT, _DOT = r"[\[({]\s*at\s*[\])}]", r"[\[({]\s*dot\s*[\])}]"
_EMAIL_END = re.compile(rf"(\.|{_DOT}\s*)[a-z]{{2,}}\Z")


def _fits(kind: str, text: str, before: str = "") -> bool:
    """Whether a tagged span can be of its kind; ``before`` is the text that leads to it."""
    d = _digits(text)
    if kind == "email":
        low = text.lower()
        return ("@" in text or bool(re.search(_AT, low))) and bool(_EMAIL_END.search(low)) and len(text) >= 6
    if kind == "ip":
        parts = re.split(r"[^0-9]+", text.strip("[](){} "))
        return len(parts) == 4 and all(p and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(d) <= 15 and not text[0].isalpha()
    return len(text) >= 16 and bool(re.search("[A-Za-z]", text)) and not re.search(r"\s", text) and (len(d) >= 4 or bool(_ASSIGNED.search(before)))


def _made_up(rng: np.random.Generator) -> tuple[str, list[tuple[str, int, int]]]:
    """A text of about two windows with labelled spans and look-alikes that are none."""
    pick = lambda s: s[int(rng.integers(len(s)))]
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve qué é ñ ü ß ment ción lich ung eau".split()
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 5))))

    def card() -> str:
        body = num(int(rng.choice([11, 14, 15, 15, 15])))
        d = next(body + str(c) for c in range(10) if luhn(body + str(c)))
        sep = pick(["", "", " ", "-", ".", "/"])
        return sep.join(d[k : k + 4] for k in range(0, len(d), 4))

    def phone() -> str:
        return pick([f"+1 ({num(3)}) {num(3)}-{num(4)}", f"+{pick('123459')}{num(1)} {num(3)} {num(4)} {num(2)}", f"({num(3)}) {num(3)}-{num(4)}", f"00{num(2)} {num(3)} {num(6)}", f"+1.{num(3)}.{num(3)}.{num(4)}"])

    def email() -> str:
        local, host = word() + pick(["", ".", "_"]) + pick([word(), num(2), ""]), pick(["mail", "post", "web", word()]) + pick(["", "", num(1)]) + pick([".example.com", ".org", ".net", ".example.de", ".co"])
        local = local.rstrip("._") or "a"
        opened, closed = pick([("[", "]"), ("(", ")"), ("{", "}")])
        blank = pick(["", " "])
        at, dot = f"{blank}{opened}at{closed}{blank}", f"{blank}{opened}dot{closed}{blank}"
        return pick([f"{local}@{host}", f"{local}@{host}", f"{local}{at}{host}", f"{local}{at}{host.replace('.', dot)}", f"{local} @ {host}"])

    def ip() -> str:
        sep = pick([".", ".", "[.]", " . "])
        return sep.join(str(int(x)) for x in rng.integers(0, 256, 4))

    def secret() -> str:
        if rng.random() < 0.25:  # a passphrase: told by what it is assigned to
            made = "".join(word() for _ in range(12)).encode("ascii", "ignore").decode()
            return (made + "longerthansixteen")[: int(rng.integers(16, 30))]
        abc = pick(["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"])
        return "".join(pick(abc) for _ in range(int(rng.choice([20, 24, 32, 40, 40, 40]))))

    make = {"email": email, "ip": ip, "card": card, "phone": phone, "secret": secret}
    near_misses = (lambda: num(4), lambda: f"{num(2)}.{num(2)}.{num(4)}", lambda: f"{num(3)},{num(3)}", lambda: f"v{num(1)}.{num(1)}.{num(1)}", lambda: f"{num(1)}:{num(2)}", lambda: f"@{word()}", lambda: f"{num(2)}%", lambda: f"$ {num(3)}.{num(2)}", lambda: num(7), lambda: f"{num(4)}-{num(2)}-{num(2)}")
    text, spans = "", []
    while len(text) < 2 * TIME:
        r = rng.random()
        if r < 0.1:
            kind = pick(KINDS)
            if kind == "secret":
                text += pick(['token = "', 'key="', "secret: ", "password=", "password: ", "api_key = '", 'secret = "', "TOKEN=", "auth: "])
            made = make[kind]()
            spans.append((kind, len(text), len(text) + len(made)))
            text += made + pick([" ", " ", ". ", ", ", '" ', "### "])
        elif r < 0.18:
            text += pick(near_misses)() + pick([" ", ". ", ", "])
        elif r < 0.2:
            text += "".join(word() for _ in range(6))[: int(rng.integers(14, 28))] + pick([" ", ". ", ", "])  # a long word
        elif r < 0.24:
            text += pick(["to ", "is ", "at ", "mail ", "the ", "an ", "key: ", "note: "])
        else:
            text += word().capitalize() if rng.random() < 0.1 else word()
            text += pick([" "] * 12 + [". ", ", ", "\n", "$$$ ", " | "])
    return text, spans


def training_batches(n: int, rows: int, seed: int = 11):
    rng = np.random.default_rng(seed)
    for _ in range(n):
        idx, gold = np.empty((rows, TIME), np.int64), np.zeros((rows, TIME), np.int64)
        for r in range(rows):
            text, spans = _made_up(rng)
            at = int(rng.integers(0, len(text) - TIME))
            idx[r] = inputs(text[at : at + TIME])
            for kind, a, b in spans:
                a, b, tag = a - at, b - at, 1 + 2 * KINDS.index(kind)
                if a < TIME and b > 0:
                    gold[r, max(0, a) : b] = tag + 1
                    gold[r, max(0, a)] = tag  # a span that the window cuts begins at its edge
        yield idx, gold


@lru_cache(maxsize=1)
def trained_tagger() -> CharTagger:
    """The tagger, trained once in a process; the same seeds give the same weights but for a machine's rounding."""
    tagger = CharTagger(KINDS)
    tagger.train(training_batches(BATCHES, ROWS), BATCHES)
    return tagger


_WEIGHT = (1 + np.minimum(np.arange(TIME), np.arange(TIME)[::-1])).astype(np.float32)
#: what every text with a span that ``_fits`` accepts holds somewhere: a digit, an at-sign, plain or bracketed, or 16 characters that are assigned
_NEEDED = re.compile(rf"[0-9@]|{_AT}|[=:]\s?[\"'`]?\S{{16}}", re.IGNORECASE)
#: characters of a part, and of the overlap in which two parts are joined outside of spans; multiples of half a window
PART, OVERLAP = 4096, 256
#: characters of parts tagged together
_TOGETHER = 300_000


def tag_spans(tagger: CharTagger, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """Spans that the tagger finds in each text, all of which is read.

    Long texts are tagged in overlapping parts; where two parts have no place in common at which both are outside
    of spans, they are tagged again as one, so that a span of any length is found whole.
    """
    found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    parts = {k: [(a, min(len(t), a + PART + OVERLAP)) for a in range(0, max(1, len(t) - OVERLAP), PART)] for k, t in enumerate(texts) if _NEEDED.search(t)}
    while parts:
        tags = _tag_parts(tagger, texts, [(k, a, b) for k, own in parts.items() for a, b in own])
        again = {}
        for k, own in parts.items():
            cuts = [_cut(tags[k, *x], tags[k, *y], x, y) for x, y in zip(own, own[1:])]
            if None in cuts:
                merged = own[:1]
                for cut, part in zip(cuts, own[1:]):
                    if cut is None:
                        merged[-1] = merged[-1][0], part[1]
                    else:
                        merged.append(part)
                again[k] = merged
                continue
            edges = [0, *cuts, len(texts[k])]
            line = np.concatenate([tags[k, a, b][x - a : y - a] for (a, b), x, y in zip(own, edges, edges[1:])])
            found[k] = _spans(line, texts[k])
        parts = again
    return found


def _cut(left: np.ndarray, right: np.ndarray, x: tuple[int, int], y: tuple[int, int]) -> int | None:
    """The place nearest the middle of the overlap of parts x and y at which both are outside of spans."""
    outside = np.flatnonzero((left[y[0] - x[0] :] == 0) & (right[: x[1] - y[0]] == 0))
    return y[0] + int(outside[np.abs(outside - (x[1] - y[0]) // 2).argmin()]) if len(outside) else None


def _spans(line: np.ndarray, text: str) -> list[tuple[str, int, int]]:
    out = []
    for t in np.flatnonzero(line % 2 == 1).tolist():
        end = t + 1
        while end < len(line) and line[end] == line[t] + 1:
            end += 1
        kind = KINDS[(line[t] - 1) // 2]
        if _fits(kind, text[t:end], text[max(0, t - 24) : t]):
            out.append((kind, t, end))
    return out


def _tag_parts(tagger: CharTagger, texts: list[str], parts: list[tuple[int, int, int]]) -> dict[tuple[int, int, int], np.ndarray]:
    """Tags of each part (text, start, end)."""
    parts, tags = sorted(parts, key=lambda s: s[2] - s[1]), {}
    while parts:
        some, longest = [], parts[-1][2] - parts[-1][1]
        while parts and (not some or (len(some) + 1) * longest <= _TOGETHER):
            some.append(parts.pop())
        tags |= zip(some, _tag_together(tagger, texts, some))
    return tags


def _tag_together(tagger: CharTagger, texts: list[str], some: list[tuple[int, int, int]]) -> list[np.ndarray]:
    sizes = np.array([b - a for _, a, b in some])
    half = TIME // 2
    padded = max(TIME, -(-int(sizes.max()) // half) * half)
    idx = np.full((len(some), padded), int(inputs(" ")[0]), np.int64)
    for r, (k, a, b) in enumerate(some):
        idx[r, : b - a] = inputs(texts[k][a:b])
    starts = np.arange(0, padded - TIME + 1, half)
    row, at = np.nonzero(starts[None, :] < sizes[:, None])
    n_tags = 1 + 2 * len(KINDS)
    total, weight = np.zeros((len(some), padded, n_tags), np.float32), np.full((len(some), padded, 1), 1e-9, np.float32)
    for first in range(0, len(row), 2048):  # a window's inner state is ten times its text
        r, s = row[first : first + 2048], starts[at[first : first + 2048]]
        scores = tagger.scores(idx[r[:, None], s[:, None] + np.arange(TIME)])
        for parity in (0, 1):  # windows of one parity never overlap each other
            own = s // half % 2 == parity
            where = r[own][:, None], s[own][:, None] + np.arange(TIME)
            total[where] += scores[own] * _WEIGHT[None, :, None]
            weight[where] += _WEIGHT[None, :, None]
    lines = tagger.best_paths(total / weight, sizes)
    return [lines[r, :n] for r, n in enumerate(sizes.tolist())]


def find_spans(tagger: CharTagger, texts: list[str]) -> list[tuple[list, list]]:
    """(rule spans, spans that the tagger adds) of each text."""
    out = []
    for text, tagged in zip(texts, tag_spans(tagger, texts)):
        rules = rule_spans(text)
        added, taken = [], [(a, b) for _, a, b in rules]
        for kind, a, b in tagged:
            if all(b <= x or a >= y for x, y in taken):
                added.append((kind, a, b))
                taken.append((a, b))
        out.append((rules, added))
    return out


_SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rules, added): both arrays of (kind, start, end) in code points."""
    tagger = trained_tagger()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = find_spans(tagger, part.column(1).to_pylist())
                columns = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in f[k]] for f in found], _SPAN_TYPE) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["id", "rules", "added"])

    source = id_text(docs, id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, rules {_SPANS}, added {_SPANS}").withColumnRenamed("id", id_col)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or union of overlapping spans, replaced by the first one's kind: ``[EMAIL]``."""
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += (text[last:a], f"[{kind.upper()}]")
        last = max(last, b)
    return "".join(out) + text[last:]


def redact_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with all spans redacted; texts without any stay as they are."""
    tagger, where, columns = trained_tagger(), docs.columns.index(text_col), docs.columns

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(where).to_pylist()
                new = [None if t is None else redact(t, rules + added) for t, (rules, added) in zip(texts, find_spans(tagger, [t or "" for t in texts]))]
                arrays = list(part.columns)
                arrays[where] = pa.array(new, batch.schema.field(where).type)
                yield pa.RecordBatch.from_arrays(arrays, columns)

    return docs.mapInArrow(run, docs.schema)


def _listed(spans: str):
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(documents(spark, sf_dir))
    order = F.array(*map(F.lit, KINDS))
    keyed = F.array_sort(F.transform(F.concat("rules", "added"), lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("o"), s["end"].alias("end"), s["kind"].alias("kind"))))
    found = found.withColumn("every", keyed)
    return found.select(
        "doc_id",
        *[_count("rules", k).alias(f"n_{k}") for k in RULE_KINDS],
        F.sha2(_listed("rules").cast("binary"), 256).alias("base_sha256"),
        _listed("every").alias("spans"),
        F.size("every").cast("bigint").alias("n_spans"),
    )
