"""Plain versions of the operators, for comparison."""

import re
import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers
import sentencepiece
import xxhash

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def hexed(text):
    return sha256(text.encode()).hexdigest()


def repeats(docs, window=35):
    """Rows of op1 from ``(doc_id, text)``."""
    words = [SPACE.findall(text or "") for _, text in docs]
    seen = {}
    for at, tokens in enumerate(words):
        for start in range(len(tokens) - window + 1):
            seen.setdefault(tuple(tokens[start : start + window]), []).append((at, start))
    gone = [set() for _ in words]
    for places in seen.values():
        if len(places) > 1:
            for at, start in places:
                gone[at].update(range(start, start + window))
    return [
        (doc_id, len(tokens), len(out), hexed(" ".join(w for i, w in enumerate(tokens) if i not in out)))
        for (doc_id, _), tokens, out in zip(docs, words, gone, strict=True)
    ]


def luhn(digits):
    total = 0
    for at, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + at % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def personal(text):
    """Base spans of op6."""
    found = []
    for number, (kind, pattern) in enumerate(BASE.items()):
        for match in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", match[0])
            fits = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in match[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if fits:
                found.append((match.start(), number, match.end(), kind))
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


def fingerprint(text):
    words = SPACE.findall(lower(text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = np.zeros(64, int)
    for shingle in shingles:
        value = xxhash.xxh64_intdigest(shingle.encode(), 42)
        ones += [value >> bit & 1 for bit in range(64)]
    return sum(1 << bit for bit in range(64) if 2 * ones[bit] > len(shingles))


def components(docs, radius=2):
    """Rows of op8 from ``(doc_id, text)``."""
    prints = [fingerprint(text) for _, text in docs]
    values = sorted(set(prints))
    number = {value: at for at, value in enumerate(values)}
    parent = list(range(len(values)))

    def root(at):
        while parent[at] != at:
            at = parent[at]
        return at

    array = np.array(values, np.uint64)
    for at, value in enumerate(array):
        for other in np.flatnonzero(np.bitwise_count(array ^ value) <= radius):
            a, b = root(at), root(int(other))
            parent[max(a, b)] = min(a, b)
    ids = {}
    for (doc_id, _), value in zip(docs, prints, strict=True):
        if doc_id is not None:
            key = root(number[value])
            ids[key] = min(doc_id, ids.get(key, doc_id))
    return [
        (doc_id, f"{value:016x}", ids.get(root(number[value])))
        for (doc_id, _), value in zip(docs, prints, strict=True)
    ]


def contamination(docs, items, window=13):
    """Rows of op9 from ``(doc_id, text)`` and ``(item_id, text)``."""
    windows = {}
    for item, text in items:
        words = WORD.findall(lower(text or ""))
        for at in range(max(1, len(words) - window + 1) if words else 0):
            owners = windows.setdefault(tuple(words[at : at + window]), set())
            if item is not None:  # hit like any other, but with no name to list
                owners.add(str(item))
    sizes = {len(w) for w in windows}
    rows = []
    for doc_id, text in docs:
        words = WORD.findall(lower(text or ""))
        hit, found = set(), set()
        for size in sizes:
            for at in range(len(words) - size + 1):
                owners = windows.get(tuple(words[at : at + size]))
                if owners is not None:
                    hit.update(range(at, at + size))
                    found |= owners
        bad = len(hit) > 0 and 20 * len(hit) >= len(words)
        rows.append((doc_id, len(words), len(hit), len(found), hexed(",".join(sorted(found))), bad))
    return rows


def tokens(docs):
    """Rows of op10 from ``(doc_id, text)``."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = []
    for doc_id, text in docs:
        ids = model.encode(text or "", add_bos=True, add_eos=True)
        coded = sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        rows.append((doc_id, len(ids), coded, hexed(model.decode(ids))))
    return rows


def licenses(text, templates, least=0.8, lengths=2):
    """Templates of which some window of so many template lengths, slid by one shingle, has
    ``least`` of the shingles."""

    def shingles(value):
        words = [w for w in re.split("[^a-z0-9]+", value.lower()) if w]
        return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]

    own, found = shingles(text or ""), set()
    for name, template in templates.items():
        listed = shingles(template)
        wanted, span = set(listed), lengths * len(listed)
        if len(wanted.intersection(own)) < least * len(wanted):
            continue
        for at in range(max(1, len(own) - span + 1)):
            if len(wanted.intersection(own[at : at + span])) >= least * len(wanted):
                found.add(name)
                break
    return found


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def differenced(sizes, shards):
    """Sums of the shards by plain Karmarkar-Karp: the two partitions of largest spread are put
    together, the heaviest part of one with the lightest of the other, until one is left."""
    parts = [(at, [[size], *[[] for _ in range(shards - 1)]]) for at, size in enumerate(sizes)]

    def spread(partition):
        sums = [sum(part) for part in partition]
        return max(sums) - min(sums)

    made = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda entry: (-spread(entry[1]), entry[0]))
        (_, left), (_, right), *rest = parts
        left, right = sorted(left, key=sum, reverse=True), sorted(right, key=sum)
        parts = [*rest, (made, [a + b for a, b in zip(left, right, strict=True)])]
        made += 1
    return sorted(map(sum, parts[0][1])) if parts else [0] * shards


def neighbour_votes(docs, labels, quality):
    """Scores of op3 from ``(doc_id, text)`` and the labels by id: terms counted as the operator
    does, all else plainly, in double precision."""
    counted = {doc_id: quality.counts((text or "").encode()).astype(float) for doc_id, text in docs}
    every = np.stack([counted[doc_id] for doc_id, _ in docs])
    rarity = np.log((1 + len(docs)) / (1 + (every > 0).sum(0))) + 1

    def unit(rows):
        lengths = np.linalg.norm(rows, axis=-1, keepdims=True)
        return rows / np.where(lengths > 0, lengths, 1)

    train = [i for i in sorted(counted) if i in labels and not held_out(i)]
    assert len(train) <= quality.TRAIN_ROWS
    weighted = unit(np.sqrt(np.stack([counted[i] for i in train])) * rarity)
    _, _, directions = np.linalg.svd(weighted, full_matrices=False)
    space = directions[: quality.DIMENSIONS].T
    known = unit(weighted @ space)
    scores = {}
    for doc_id, row in counted.items():
        cosines = known @ unit(unit(np.sqrt(row) * rarity) @ space)
        nearest = sorted(range(len(train)), key=lambda at: -cosines[at])[: quality.NEIGHBOURS]
        votes = [(max(cosines[at], 0) ** quality.SHARPNESS, labels[train[at]]) for at in nearest]
        total = sum(vote for vote, _ in votes)
        prior = sum(labels[i] for i in train) / len(train)
        scores[doc_id] = sum(v * label for v, label in votes) / total if total else prior
    return scores
