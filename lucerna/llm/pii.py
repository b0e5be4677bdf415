"""Personal data: four base patterns, and a skip-chain conditional random field that adds spans.

Base spans (email, ip, card, phone) come from patterns with checks, leftmost and without overlap per kind.
The field labels the white-space tokens around anything with a digit, an at sign or a written-out one. A token's
potentials are learned weights of its shape, affixes and neighbours; consecutive tokens share transition weights; all
tokens of a document that are equal, or equal but for marks and separators, are joined through a node of their own,
whose learned weights favour one label for all of them, however far apart they are and however many. Loopy message
passing (max-product, damped) runs until the messages settle, MOST_ROUNDS at most, and so labels the document as a whole:
what is clear in one place carries over to where the context is poor. A run of tokens labelled as a kind that no base span
touches adds a span if it has that kind's form and passes its check (Luhn, parts at most 255, number of digits).

The weights are learned by averaged structured perceptron on base-labelled passages, with part of the spans
altered (separators changed, prefixes dropped, at signs written out) so that the field sees what the patterns miss, and with
numbers that fail their checks as counter-examples: at most max_train_docs documents, chosen by the least hashes of
doc_id, and of each at most PASSAGES passages around digits and at signs, evenly spread over the text: a bounded and
documented sample. Scoring covers every text, whole.

Chains are split where no candidate is near, so cost follows the candidates. Runs of digits are searched in time linear
in their length.

Defined results: null and empty texts have no spans; repeated rows repeat their result; offsets are code
points, ends exclusive; without training documents the field adds nothing; an empty table gives an empty
result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_texts

KINDS = ("email", "ip", "card", "phone")
# The patterns of the contract.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOTTED, DIGITS = re.compile(r"[0-9]+(?:\.[0-9]+){3,}"), re.compile(r"[0-9]+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[Span]:
    """Matches of EMAIL, searched from the run of local characters before each at sign."""
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text[start - 1]):
            start -= 1
        match = EMAIL.match(text, start) if start < at else None
        if match:
            found.append(("email", start, match.end()))
            done = match.end()
        at = text.find("@", max(at + 1, done))
    return found


def addresses(text: str) -> list[Span]:
    """Matches of IP with parts of at most 255.

    IP takes whole runs of digits, so a match begins at a run's start unless a match before ended inside the chain of
    runs joined by single dots: such a chain is cut into fours from its start.
    """
    found = []
    for chain in DOTTED.finditer(text):
        parts = [m.span() for m in DIGITS.finditer(text, *chain.span())]
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            if all(b - a < 4300 and int(text[a:b]) <= 255 for a, b in four):
                found.append(("ip", four[0][0], four[3][1]))
    return found


def base_spans(text: str) -> list[Span]:
    """The contract's spans, by kind as listed, then start."""
    found = emails(text) if "@" in text else []
    if not re.search("[0-9]", text):
        return found
    found += addresses(text)
    for m in CARD.finditer(text):
        digits = only_digits(m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(only_digits(m.group())) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


# ---- the field ----

LABELS = ("O", *KINDS)
DIM = 1 << 14
NEAR = 2
MOST_ROUNDS, SETTLED, DAMPING = 100, 1e-6, 0.5
#: Characters of a token's shape that are a feature, and characters of a token that are looked at for it.
SHAPE_CHARS, TOKEN_CHARS = 24, 256
PASSAGES, PASSAGE_CHARS = 20, 400
#: Rows that training looks at for each one that it takes.
SPARE = 8
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
CANDIDATE = re.compile(r"[0-9@]|[(\[_]at[)\]_]", re.IGNORECASE)


def shape(token: str) -> str:
    """Digits as 9, letters as a; runs longer than four as four; its first SHAPE_CHARS characters."""
    out = re.sub(r"[0-9]", "9", token[:TOKEN_CHARS])
    out = re.sub(r"[^\W\d_]", "a", out)
    return re.sub(r"(.)\1{4,}", r"\1\1\1\1", out)[:SHAPE_CHARS]


def alike(token: str) -> str:
    """What equal tokens share when marks and separators don't count."""
    return re.sub(r"[\W_]+", "", token).lower()


def slot(feature: str) -> int:
    return int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=4).digest(), "little") % DIM


_slots: dict[str, int] = {}


def token_features(tokens: list[str], i: int) -> list[int]:
    def of(k: int, name: str) -> str:
        return f"{name}={shape(tokens[k]) if 0 <= k < len(tokens) else '-'}"

    token = tokens[i]
    digits = len(number := only_digits(token))
    letters = sum(c.isalpha() for c in token)
    form = f"{min(digits, 20)}|{min(letters, 3)}"
    names = [
        "bias", f"luhn={13 <= digits <= 19 and luhn(number)}", of(i, "s"), of(i - 1, "p"), of(i + 1, "n"), f"d={form}", f"at={bool(AT.search(token))}", f"plus={token[0] == '+'}",
        f"dots={token.count('.')}", f"dash={token.count('-')}", f"dn={form}|{of(i + 1, 'n')}", f"dp={form}|{of(i - 1, 'p')}",
    ]
    out = []
    for name in names:
        if name not in _slots:
            if len(_slots) > 200_000:
                _slots.clear()
            _slots[name] = slot(name)
        out.append(_slots[name])
    return out


class Graph:
    """Tokens near candidates, chain edges between neighbours, and a shared node for alike tokens that occur more than once."""

    def __init__(self, text: str):
        spots = [m.span() for m in TOKEN.finditer(text)]
        words = [text[a:b] for a, b in spots]
        live: set[int] = set()
        for i, word in enumerate(words):
            if CANDIDATE.search(word):
                live.update(range(max(0, i - NEAR), min(len(words), i + NEAR + 1)))
        self.index = sorted(live)
        self.spans = [spots[i] for i in self.index]
        self.words = [words[i] for i in self.index]
        self.features = [token_features(words, i) for i in self.index]
        self.chain = [(k, k + 1) for k in range(len(self.index) - 1) if self.index[k + 1] == self.index[k] + 1]
        groups: dict[str, list[int]] = {}
        for k, word in enumerate(self.words):
            key = alike(word)
            if len(key) >= 6 and CANDIDATE.search(word):
                groups.setdefault(key, []).append(k)
        #: (token, number of its shared node) for tokens with others alike.
        shared = [ks for ks in groups.values() if len(ks) > 1]
        self.shared = len(shared)
        self.skip = [(k, g) for g, ks in enumerate(shared) for k in ks]

    def gold(self, spans: list[Span]) -> np.ndarray:
        """The label of each token by the spans that it overlaps."""
        out = np.zeros(len(self.words), np.int64)
        starts = [x for x, _ in self.spans]
        for kind, a, b in spans:
            k = max(0, bisect_right(starts, a) - 1)
            while k < len(starts) and starts[k] < b:
                if self.spans[k][1] > a:
                    out[k] = LABELS.index(kind)
                k += 1
        return out


def max_product(own: np.ndarray, edges: list[tuple[int, int]], tables: np.ndarray) -> np.ndarray:
    """Labels by damped loopy max-product message passing until messages settle: own scores of nodes, a score table for each edge.

    Exact on trees; on graphs with cycles it gives a fixed point's labels where it settles within MOST_ROUNDS.
    """
    if not edges:
        return own.argmax(1)
    a, b = np.array(edges).T
    # Directed messages: a to b, then b to a.
    source, target = np.concatenate((a, b)), np.concatenate((b, a))
    potential = np.concatenate((tables, tables.transpose(0, 2, 1)))
    back = np.concatenate((np.arange(len(a)) + len(a), np.arange(len(a))))
    message = np.zeros((len(source), own.shape[1]))
    for _ in range(MOST_ROUNDS):
        belief = own.copy()
        np.add.at(belief, target, message)
        sent = ((belief[source] - message[back])[:, :, None] + potential).max(1)
        sent -= sent.max(1, keepdims=True)
        moved = np.abs(sent - message).max()
        message = DAMPING * message + (1 - DAMPING) * sent
        if moved < SETTLED:
            break
    belief = own.copy()
    np.add.at(belief, target, message)
    return belief.argmax(1)


class SkipChainField:
    """Weights of features, of label pairs on chain edges, and of agreement with the shared node for each label."""

    def __init__(self):
        n = len(LABELS)
        self.unary, self.pair, self.skip = np.zeros((DIM, n)), np.zeros((n, n)), np.zeros(n)

    def decode(self, graph: Graph) -> np.ndarray:
        """Labels of the tokens, all of a document's together."""
        n = len(graph.words)
        if not n:
            return np.zeros(0, np.int64)
        own = np.array([self.unary[f].sum(0) for f in graph.features] + [np.zeros(len(LABELS))] * graph.shared)
        edges = graph.chain + [(k, n + g) for k, g in graph.skip]
        tables = np.stack([self.pair] * len(graph.chain) + [np.diag(self.skip)] * len(graph.skip)) if edges else np.zeros((0, 1, 1))
        return max_product(own, edges, tables)[:n]

    def shift(self, graph: Graph, labels: np.ndarray, by: float) -> None:
        for features, y in zip(graph.features, labels, strict=True):
            np.add.at(self.unary[:, y], features, by)
        for i, j in graph.chain:
            self.pair[labels[i], labels[j]] += by
        # The shared node's label is what most of its tokens have.
        votes = np.zeros((graph.shared, len(LABELS)))
        for k, g in graph.skip:
            votes[g, labels[k]] += 1
        for k, g in graph.skip:
            if labels[k] == votes[g].argmax():
                self.skip[labels[k]] += by


def altered(text: str, spans: list[Span], rng: random.Random) -> tuple[str, list[Span]]:
    """The text with some spans written as the patterns don't expect, and where the spans are then."""
    out, moved, done = [], [], 0
    at = 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a < done:
            continue
        piece = text[a:b]
        if rng.random() < 0.4:
            if kind == "card" and piece.isdigit():
                piece = rng.choice("._/").join(piece[k : k + 4] for k in range(0, len(piece), 4))
            elif kind == "phone":
                piece = piece.lstrip("+")
            elif kind == "email":
                piece = piece.replace("@", rng.choice(["(at)", "[at]", "_at_"]))
            elif kind == "ip":
                piece = piece.replace(".", rng.choice(["[.]", "(.)", "-"]))
        out.append(text[done:a])
        at += a - done
        moved.append((kind, at, at + len(piece)))
        out.append(piece)
        at += len(piece)
        done = b
    out.append(text[done:])
    return "".join(out), moved


def train_field(samples: list[tuple[int, str]], epochs: int = 8) -> SkipChainField | None:
    """The field learned from base-labelled texts and their alterations; None without any span."""
    examples = []
    for doc_id, text in samples:
        spans = base_spans(text)
        if not CANDIDATE.search(text):
            continue
        for version in (0, 1):
            t, s = (text, spans) if version == 0 else altered(text, spans, random.Random(doc_id))
            graph = Graph(t)
            examples.append((graph, graph.gold(s)))
    if not any(gold.any() for _, gold in examples):
        return None
    field, total = SkipChainField(), SkipChainField()
    rng = random.Random(7)
    for _ in range(epochs):
        rng.shuffle(examples)
        for graph, gold in examples:
            guess = field.decode(graph)
            if (guess != gold).any():
                field.shift(graph, gold, 1.0)
                field.shift(graph, guess, -1.0)
        for name in ("unary", "pair", "skip"):
            setattr(total, name, getattr(total, name) + getattr(field, name) / epochs)
    return total


#: What an added span of a kind looks like: an address with a written-out at sign and a dot behind it; else digits and separators alone.
AT = re.compile(r"@|[(\[_]at[)\]_]", re.IGNORECASE)
FORMS = {
    "email": re.compile(r"[\w.%+-]+(?:@|[(\[_]at[)\]_])[\w-]+(?:\.[\w-]+)+", re.IGNORECASE),
    "ip": re.compile(r"[0-9]{1,3}(?:[^0-9A-Za-z\s]{1,3}[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9](?:[\W_]?[0-9])+"),
    "phone": re.compile(r"\+?\(?[0-9](?:[\W_]{0,2}[0-9])+"),
}


def plausible(kind: str, piece: str) -> bool:
    """Whether a piece has the form of a kind and passes the kind's check."""
    if len(piece) > 254 or not FORMS[kind].fullmatch(piece):
        return False
    digits = only_digits(piece)
    if kind == "ip":
        return all(int(p) <= 255 for p in DIGITS.findall(piece))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def field_spans(field: SkipChainField, text: str, base: list[Span]) -> list[Span]:
    """Spans of runs of tokens with one kind that no base span touches, without surrounding marks."""
    graph = Graph(text)
    labels = field.decode(graph).tolist()
    taken = sorted((a, b) for _, a, b in base)
    ends = list(accumulate((b for _, b in taken), max))
    found = []
    k = 0
    while k < len(labels):
        end = k + 1
        while end < len(labels) and labels[end] == labels[k] and graph.index[end] == graph.index[end - 1] + 1:
            end += 1
        if labels[k]:
            kind, a, b = LABELS[labels[k]], graph.spans[k][0], graph.spans[end - 1][1]
            while a < b and not (text[a].isalnum() or text[a] in "+("):
                a += 1
            while a < b and not text[b - 1].isalnum():
                b -= 1
            before = bisect_right(taken, (b - 1, len(text) + 1))
            if plausible(kind, text[a:b]) and not (before and ends[before - 1] > a):
                found.append((kind, a, b))
        k = end
    return found


def passages_near(text: str) -> str:
    """At most PASSAGES passages around digits and at signs, evenly spread over the text, PASSAGE_CHARS characters each at most."""
    islands: list[list[int]] = []
    for m in CANDIDATE.finditer(text):
        a, b = max(0, m.start() - 60), m.end() + 60
        if islands and a <= islands[-1][1] and b - islands[-1][0] <= PASSAGE_CHARS:
            islands[-1][1] = b
        else:
            islands.append([a, b])
    step = max(1, -(-len(islands) // PASSAGES))
    return " \n ".join(text[a:b] for a, b in islands[::step])


def training_texts(docs: DataFrame, max_train_docs: int) -> list[tuple[int, str]]:
    """Passages of at most max_train_docs documents with digits or at signs, those with the least hashes of doc_id and text:
    the same ones at each run. Only a share of all rows by that hash is looked at, raised until it holds enough, so what
    reaches the driver is bounded by SPARE * max_train_docs rows or so, not by the table or the number of tasks."""

    @F.pandas_udf("string")
    def near(texts):
        return texts.map(passages_near)

    ranked = doc_texts(docs).withColumn("rank", F.xxhash64("doc_id", "text"))
    share = SPARE * max_train_docs / max(1, docs.count())
    while True:
        some = ranked if share >= 1 else ranked.where(F.col("rank") < F.lit(int(share * (1 << 64)) - (1 << 63)))
        least = some.where(F.col("text").rlike(r"[0-9]{2}|@")).select("rank", "doc_id", near("text").alias("text")).orderBy("rank").limit(max_train_docs)
        found = least.collect()
        if len(found) == max_train_docs or share >= 1:
            return [(r.doc_id or 0, r.text) for r in found]
        share *= min(SPARE, max(2.0, 1.5 * max_train_docs / max(1, len(found))))


def personal_data(docs: DataFrame, max_train_docs: int = 2_000) -> DataFrame:
    """doc_id, counts of base spans, their digest, all spans and how many the field added, for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(train_field(training_texts(docs, max_train_docs)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        order = {kind: i for i, kind in enumerate(KINDS)}

        def told(spans: list[Span]) -> str:
            return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1])))

        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            columns: list[list] = [[] for _ in range(8)]
            for value in batch.column(1):
                text = value.as_py()
                if not CANDIDATE.search(text):
                    row = (0, 0, 0, 0, nothing, "", 0)
                else:
                    base = base_spans(text)
                    added = field_spans(field, text, base) if field else []
                    counts = [sum(s[0] == kind for s in base) for kind in KINDS]
                    row = (*counts, hashlib.sha256(told(base).encode()).hexdigest(), told(base + added), len(added))
                for column, x in zip(columns[1:], row, strict=True):
                    column.append(x)
            types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns[1:], types, strict=True))],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
            )

    return doc_texts(docs).mapInArrow(
        find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    )
