"""Sequence labelling of address tokens: features, linear-chain scoring, perceptron training."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from collections.abc import Iterable

import numpy as np

from . import lexicon as lx
from .lexer import Token, TokenType, is_numeric, is_punctuation, tokenize
from .text import COMPOSE, LOWERCASE, SIMPLE_LATIN_ASCII, TRIM, normalize_string

LABELS = (
    "house", "category", "near", "house_number", "road", "unit", "level", "staircase", "entrance", "po_box", "postcode", "suburb", "city_district", "city", "island", "state_district",
    "state", "country_region", "country", "world_region", "website", "telephone",
)
SEPARATORS = ("sep", "fsep")
_OPTIONS = SIMPLE_LATIN_ASCII | COMPOSE | LOWERCASE | TRIM


def read_tagged(line: str) -> list[tuple[str, str]]:
    """(token, label) of a tagged address; a token's label follows its last slash."""
    out = []
    for part in line.split():
        token, _, label = part.rpartition("/")
        if not token or not label:
            raise ValueError(f"untagged token {part!r}")
        out.append((token, label))
    return out


def input_tokens(text: str) -> list[Token]:
    return [t for t in tokenize(normalize_string(text, _OPTIONS)) if not is_punctuation(t.type) or t.type == TokenType.POUND]


def word_features(tokens: list[Token], vocabulary: Counter | dict | None = None, rare: int = 5, dictionary: lx.Dictionary | None = None) -> list[list[str]]:
    """Per token its features; the label before is not among them (the model has transitions)."""
    d = dictionary or lx.default_dictionary()
    n = len(tokens)
    kinds: list[set[str]] = [set() for _ in tokens]
    phrase_at: list[str] = [""] * n
    for space in d.languages:
        for p in d.search(tokens, space):
            name = " ".join(t.text for t in tokens[p.start : p.start + p.length])
            for i in range(p.start, p.start + p.length):
                phrase_at[i] = max(phrase_at[i], name, key=len)
                for e in p.expansions:
                    kinds[i].update(("unambiguous:" if not p.ambiguous else "") + k for k in e.kinds)
    words = []
    for t in tokens:
        known = vocabulary is None or vocabulary.get(t.text, 0) >= rare
        shape = "".join("D" if c.isdigit() else c for c in t.text) if is_numeric(t.type) else t.text
        words.append(shape if known or is_numeric(t.type) else "UNKNOWN")
    out = []
    number_at = [i for i, t in enumerate(tokens) if is_numeric(t.type)]
    for i, t in enumerate(tokens):
        f = ["bias", f"word={words[i]}", *(f"kind={k}" for k in sorted(kinds[i]))]
        if phrase_at[i]:
            f.append(f"phrase={phrase_at[i]}")
        if is_numeric(t.type):
            f += ["numeric", f"digits={sum(c.isdigit() for c in t.text)}"]
        elif words[i] == "UNKNOWN" or len(t.text) > 2:
            f += [f"prefix{k}={t.text[:k]}" for k in range(3, min(7, len(t.text)))]
            f += [f"suffix{k}={t.text[-k:]}" for k in range(3, min(7, len(t.text)))]
        if i == 0:
            f.append("first")
            if words[i] == "UNKNOWN" or not is_numeric(t.type):
                after = next((j for j in number_at if j > 0), None)
                context = "number" if after is not None else "none"
                between = {k.split(":")[-1] for j in range(after if after is not None else n) for k in kinds[j]}
                f += [f"long={context}:{k}" for k in sorted(between & {"street_types", "place_names", "building_types"})]
        if i == n - 1:
            f.append("last")
        before, after_ = (words[i - 1] if i else "START"), (words[i + 1] if i + 1 < n else "END")
        f += [f"prev={before}", f"next={after_}", f"prev+word={before}|{words[i]}", f"word+next={words[i]}|{after_}"]
        f += [f"prevkind={k}" for k in sorted(kinds[i - 1])] if i else []
        f += [f"nextkind={k}" for k in sorted(kinds[i + 1])] if i + 1 < n else []
        out.append(f)
    return out


# -- linear chain


def viterbi(state: np.ndarray, trans: np.ndarray, state_trans: np.ndarray | None = None) -> tuple[float, list[int]]:
    """Best path; ``state`` (T, L), ``trans`` (L, L) from-to, ``state_trans`` (T, L, L) added to it."""
    n, _ = state.shape
    score, back = state[0].copy(), np.zeros(state.shape, int)
    for t in range(1, n):
        step = score[:, None] + trans + (state_trans[t] if state_trans is not None else 0)
        back[t] = step.argmax(0)
        score = step.max(0) + state[t]
    path = [int(score.argmax())]
    for t in range(n - 1, 0, -1):
        path.append(int(back[t, path[-1]]))
    return float(score.max()), path[::-1]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def forward(state: np.ndarray, trans: np.ndarray, state_trans: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """(log alpha, log norm)."""
    alpha = np.empty_like(state)
    alpha[0] = state[0]
    for t in range(1, len(state)):
        alpha[t] = _logsum(alpha[t - 1][:, None] + trans + (state_trans[t] if state_trans is not None else 0), 0) + state[t]
    return alpha, float(_logsum(alpha[-1], 0))


def backward(state: np.ndarray, trans: np.ndarray, state_trans: np.ndarray | None = None) -> np.ndarray:
    beta = np.zeros_like(state)
    for t in range(len(state) - 2, -1, -1):
        beta[t] = _logsum(trans + (state_trans[t + 1] if state_trans is not None else 0) + (state[t + 1] + beta[t + 1])[None, :], 1)
    return beta


def marginals(state: np.ndarray, trans: np.ndarray, state_trans: np.ndarray | None = None) -> np.ndarray:
    """(T, L) probabilities of a label at a place."""
    alpha, norm = forward(state, trans, state_trans)
    return np.exp(alpha + backward(state, trans, state_trans) - norm)


def path_score(path: list[int], state: np.ndarray, trans: np.ndarray, state_trans: np.ndarray | None = None) -> float:
    total = float(state[0, path[0]])
    for t in range(1, len(path)):
        total += float(state[t, path[t]] + trans[path[t - 1], path[t]] + (state_trans[t, path[t - 1], path[t]] if state_trans is not None else 0))
    return total


class Tagger:
    """Weights by feature and label, transitions by label pair; trained by averaged perceptron."""

    def __init__(self, labels: Iterable[str] = LABELS):
        self.labels = list(labels)
        self.index = {c: i for i, c in enumerate(self.labels)}
        self.weights: dict[str, np.ndarray] = {}
        self.trans = np.zeros((len(self.labels), len(self.labels)))
        self.vocabulary: dict[str, int] = {}

    def scores(self, features: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(features), len(self.labels)))
        for i, fs in enumerate(features):
            for f in fs:
                w = self.weights.get(f)
                if w is not None:
                    out[i] += w
        return out

    def predict(self, features: list[list[str]]) -> list[str]:
        if not features:
            return []
        return [self.labels[i] for i in viterbi(self.scores(features), self.trans)[1]]

    def greedy(self, features: list[list[str]]) -> list[str]:
        """Left to right, each label given the one before."""
        out: list[int] = []
        for row in self.scores(features):
            out.append(int((row + (self.trans[out[-1]] if out else 0)).argmax()))
        return [self.labels[i] for i in out]

    def confidence(self, features: list[list[str]]) -> list[float]:
        s = self.scores(features)
        return marginals(s, self.trans)[range(len(features)), viterbi(s, self.trans)[1]].tolist() if features else []

    def train(self, examples: list[tuple[list[list[str]], list[str]]], epochs: int = 5, min_updates: int = 0, seed: int = 0) -> Tagger:
        """Averaged perceptron over decoded paths; totals are kept lazily. Features that were updated
        fewer than ``min_updates`` times are dropped."""
        size = len(self.labels)
        total: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(size))
        since: dict[str, int] = {}
        updates: Counter[str] = Counter()
        trans_total, trans_since, now = np.zeros((size, size)), 0, 0
        order = list(range(len(examples)))
        rng = random.Random(seed)
        for _ in range(epochs):
            rng.shuffle(order)
            for k in order:
                features, gold_names = examples[k]
                if not features:
                    continue
                gold = [self.index[g] for g in gold_names]
                _, path = viterbi(self.scores(features), self.trans)
                now += 1
                if path == gold:
                    continue
                for i, (g, p) in enumerate(zip(gold, path, strict=True)):
                    if g != p:
                        for f in features[i]:
                            w = self.weights.get(f)
                            if w is None:
                                w = self.weights[f] = np.zeros(size)
                            total[f] += (now - since.get(f, now)) * w
                            since[f] = now
                            updates[f] += 1
                            w[g] += 1
                            w[p] -= 1
                    if i and (g != p or gold[i - 1] != path[i - 1]):
                        trans_total += (now - trans_since) * self.trans
                        trans_since = now
                        self.trans[gold[i - 1], g] += 1
                        self.trans[path[i - 1], p] -= 1
        if now:
            for f, w in list(self.weights.items()):
                if updates[f] < min_updates:
                    del self.weights[f]
                else:
                    self.weights[f] = (total[f] + (now - since[f]) * w) / now
            self.trans = (trans_total + (now - trans_since) * self.trans) / now
        return self

    def merged(self, others: list[Tagger]) -> Tagger:
        """Parameter mixing: the mean of models trained on shards."""
        out = Tagger(self.labels)
        models = [self, *others]
        for m in models:
            for f, w in m.weights.items():
                out.weights[f] = out.weights.get(f, 0) + w / len(models)
        out.trans = sum(m.trans for m in models) / len(models)
        out.vocabulary = dict(sum((Counter(m.vocabulary) for m in models), Counter()))
        return out


def parse(text: str | None, model: Tagger, vocabulary: dict | None = None, known: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """(label, value) in order; neighbours of one label are joined as the source spaced them. ``known``
    maps a whole input that is one place name or postal code to its usual label."""
    if not text or not text.strip():
        return []
    tokens = input_tokens(text)
    whole = " ".join(t.text for t in tokens)
    if known and whole in known:
        return [(known[whole], whole)]
    labels = model.predict(word_features(tokens, vocabulary or model.vocabulary or None))
    out: list[list] = []
    for t, label in zip(tokens, labels, strict=True):
        if out and out[-1][0] == label:
            gap = " " if out[-1][2] < t.offset else ""
            out[-1][1] += gap + t.text
            out[-1][2] = t.offset + len(t.text)
        else:
            out.append([label, t.text, t.offset + len(t.text)])
    return [(a, b) for a, b, _ in out]
