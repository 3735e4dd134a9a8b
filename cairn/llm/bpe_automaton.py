"""BPE encoding and decoding with a tokenization automaton.

The merges of a BPE vocabulary are compiled, in order of priority, into a
deterministic automaton over token labels whose paths are exactly the correct
tokenizations (Berglund, Martens and van der Merwe, "Constructing a BPE
tokenization DFA").  It starts as one state that loops on every base symbol.
The gadget of a merge (u, v) -> uv puts a copy of the state that u leads to in
its place, without the arc v, and gives every state that has the arc u an arc
uv to the state that v leads to; if u's state has no arc v, nothing can merge.  All arcs of one label lead to one state,
so a state is named by its label; of each gadget it is enough to keep which arc
the state of u lost and when, and that the state of uv began as the state of v
at that time.  Looked-up arcs are kept in a transition table, which encoding
reads.

A pre-split word has one path whose labels spell it.  ``spell`` finds it left to
right: longest label first, an arc must exist, and a position from which the
word can't be finished is remembered (the path to a position is unique, so the
position alone says it), which keeps the walk linear in the word's length.
Decoding emits the labels.

Splitting a text into words (NFC, white space, lower case, the word pattern and
the byte alphabet) belongs to the vocabulary file and is done by that file's own
normalizer and pre-tokenizer; the encoding proper is this module's.

Defined cases: a null or empty text has no ids and decodes to an empty text;
special strings inside a text become their added token, as the library does by
default; each row is encoded on its own, so repeated rows and repeated or null
doc_ids give equal results for equal texts; an empty table gives an empty
table; only the named columns are read, so others can't clash.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cairn.llm.common import held_by_worker

NEVER = float("inf")
HEAD = 4
# Bounds of what a worker keeps: chunks and words in two generations each, and looked-up arcs.
MEMO_CHUNKS, MEMO_WORDS, MEMO_ARCS = 100_000, 200_000, 200_000
# The word pattern of the lower-case vocabulary, and what it is for printable
# characters before U+0250, which are in normal form C and whose case folds one by one.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
SIMPLE_END = "\u0250"


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if visible, else the next one from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(0x100 + hidden.index(b)) for b in range(256)]


CHUNK = re.compile(r"[^ \t-\r]+")  # no word of a text crosses ASCII white space


class TokenizationAutomaton:
    """The automaton of one merge list (one merge per label); see the module's docstring."""

    def __init__(self, labels: dict[str, int], merges: list[tuple[str, str]], word_end: str = ""):
        self.label = {i: s for s, i in labels.items()}
        end = len(word_end)
        self.final = {s[:-end]: i for s, i in labels.items() if s.endswith(word_end)} if end else dict(labels)
        self.inner = {s: i for s, i in labels.items() if not s.endswith(word_end)} if end else self.final
        self.reach: dict[str, int] = {}  # first HEAD characters -> longest label that begins so
        for s in labels:
            if len(s) >= HEAD:
                self.reach[s[:HEAD]] = max(len(s), self.reach.get(s[:HEAD], 0))
        self.lost: dict[tuple[int, int], int] = {}  # (state's label, arc) -> when the arc went
        self.began: dict[int, tuple[int, int]] = {}  # state's label -> (state it copies, when)
        self.made: dict[int, tuple[int, int]] = {}  # arc uv -> (arc u it needs, when)
        self.dead: set[int] = set()
        self.table: dict[tuple[int, int], bool] = {}
        for when, (u, v) in enumerate(merges):
            self._gadget(labels[u], labels[v], labels[u + v], when)

    def _gadget(self, u: int, v: int, uv: int, when: int) -> None:
        if uv in self.made:
            raise ValueError(f"two merges make {self.label[uv]!r}")
        if u in self.dead or v in self.dead or not self._holds(u, v):  # no path has this label
            self.dead.add(uv)
            for arcs in (self.final, self.inner):
                for s in [s for s, i in arcs.items() if i == uv]:
                    del arcs[s]
            return
        self.lost[u, v] = when
        self.began[uv] = (v, when)  # for u = v: the state before it lost the arc
        self.made[uv] = (u, when)

    def _gone(self, state: int, arc: int) -> float:
        """When the state, or one that it copies before the copy, lost the arc."""
        gone, until = NEVER, NEVER
        while True:
            when = self.lost.get((state, arc), NEVER)
            if when < until:
                gone = min(gone, when)
            if state not in self.began:
                return gone
            state, until = self.began[state]

    def _holds(self, state: int, arc: int) -> bool:
        """A state has the arc uv if it had u when (u, v) merged and hasn't lost uv since."""
        if self._gone(state, arc) != NEVER:
            return False
        while arc in self.made:
            arc, when = self.made[arc]
            if self._gone(state, arc) <= when:
                return False
        return True

    def has_arc(self, state: int | None, arc: int) -> bool:
        """``_holds`` through the transition table; the start loses nothing."""
        if state is None:
            return True
        key = (state, arc)
        known = self.table.get(key)
        if known is None:
            if len(self.table) >= MEMO_ARCS:
                self.table.clear()
            known = self.table[key] = self._holds(state, arc)
        return known

    def spell(self, word: str) -> list[int]:
        """The labels of the path that spells a word of the base alphabet."""
        n, at, path, starts, dead = len(word), 0, [], [], set()
        while at < n:
            state = path[-1] if path else None
            for stop in range(min(n, at + self.reach.get(word[at:at + HEAD], HEAD - 1)), at, -1):
                label = (self.final if stop == n else self.inner).get(word[at:stop])
                if label is not None and stop not in dead and self.has_arc(state, label):
                    path.append(label)
                    starts.append(at)
                    at = stop
                    break
            else:  # the word can't be finished from here: back to a shorter label
                if not path:
                    raise ValueError(f"no path spells {word[:40]!r}")
                dead.add(at)
                path.pop()
                at = starts.pop()
        return path


class AutomatonTokenizer:
    """Encodes and decodes whole texts; built from the JSON of a vocabulary file."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        content = json.loads(spec)
        model = content["model"]
        if model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("a plain BPE vocabulary is needed")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.automaton = TokenizationAutomaton(
            model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.label = self.automaton.label | {i: s for s, i in self.special.items()}
        # the library's splitter without its model
        splitter = Tokenizer.from_str(json.dumps(content | {"added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}}))
        self.normalize = splitter.normalizer.normalize_str
        self.split = splitter.pre_tokenizer.pre_tokenize_str
        # for the one word pattern this is known for, simple words go without the library's splitter
        pattern = (content["pre_tokenizer"].get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
        self.words = regex.compile(WORDS) if pattern == WORDS else None
        self.bytes = byte_alphabet()
        self.known: dict[str, tuple[int, ...]] = {}  # words
        self.known_before: dict[str, tuple[int, ...]] = {}
        names = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(names)})") if names else None
        self.memo: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}  # the memo before the last time it was full

    def _word(self, word: str) -> tuple[int, ...]:
        ids = self.known.get(word)
        if ids is None:
            ids = self.known_before.get(word) or tuple(self.automaton.spell(word))
            if len(self.known) >= MEMO_WORDS:
                self.known_before, self.known = self.known, {}
            if len(word) <= 200:
                self.known[word] = ids
        return ids

    def pre_split(self, part: str) -> list[str]:
        """The words of a text without special strings, in the byte alphabet."""
        if self.words and part.isprintable():
            if part.isascii():
                return ASCII_WORDS.findall(part.lower())
            if max(part) < SIMPLE_END and "\u0130" not in part:
                return ["".join([self.bytes[b] for b in w.encode()]) for w in self.words.findall(part.lower())]
        return [w for w, _ in self.split(self.normalize(part))]

    def encode_chunk(self, chunk: str) -> list[int]:
        ids: list[int] = []
        for part in self.cut.split(chunk) if self.cut and "<" in chunk else [chunk]:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                for word in self.pre_split(part):
                    ids += self._word(word)
        return ids

    def _learn(self, chunk: str) -> tuple[str, str]:
        found = self.older.get(chunk)
        if found is None:
            ids = self.encode_chunk(chunk)
            found = " ".join(map(str, ids)), self.decode(ids)
        if len(self.memo) >= MEMO_CHUNKS:
            self.older, self.memo = self.memo, {}
        if len(chunk) <= 200:
            self.memo[chunk] = found
        return found

    def encode(self, text: str | None) -> list[int]:
        """The ids of a whole text, as the library's encode(add_special_tokens=False)."""
        return [i for c in CHUNK.findall(text or "") for i in self.encode_chunk(c)]

    def decode(self, ids: list[int]) -> str:
        """The arcs' labels, joined as the library's decode(skip_special_tokens=False)."""
        return " ".join([self.label[i] for i in ids])

    def written(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, the ids in decimal, and the decoded text, of a whole text."""
        learn = self._learn
        parts = [self.memo.get(c) or learn(c) for c in CHUNK.findall(text or "")]
        ids = " ".join([p[0] for p in parts if p[0]])
        return ids.count(" ") + bool(ids), ids, " ".join([p[1] for p in parts if p[0]])


def tokenizer_of(spec: str) -> AutomatonTokenizer:
    """One automaton a worker and vocabulary."""
    key = "automaton", hashlib.sha256(spec.encode()).hexdigest()
    return held_by_worker(key, lambda: AutomatonTokenizer(spec))


def encode_texts(docs: DataFrame, vocabulary: str, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_tokens, digests of ids and decoded text.

    ``vocabulary`` is the path of a tokenizers JSON file, read on the driver and
    broadcast (a fixed file of a few MB).  ``with_ids`` adds the ids in decimal,
    ``with_text`` the decoded text.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(spec.value)
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            counts, ids, texts, written, decoded = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                n, a, b = tokenizer.written(text)
                counts.append(n)
                ids.append(hashlib.sha256(a.encode()).hexdigest())
                texts.append(hashlib.sha256(b.encode()).hexdigest())
                if with_ids:
                    written.append(a)
                if with_text:
                    decoded.append(b)
            out = {"doc_id": batch.column(0), "n_tokens": pa.array(counts, pa.int64()),
                   "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(texts, pa.string())}
            if with_ids:
                out["ids"] = pa.array(written, pa.string())
            if with_text:
                out["decoded"] = pa.array(decoded, pa.string())
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", ids string" * with_ids + ", decoded string" * with_text
    return docs.select(docs["doc_id"].cast("bigint"), "text").mapInArrow(run, schema)
