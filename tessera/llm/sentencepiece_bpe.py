"""Exact merge-type SentencePiece encoding by backtracking, and decoding.

A text's merge encoding is the one sequence of reachable pieces in which every two neighbours, merged again from their
characters, fall into just these two. Candidates at a position are the Aho-Corasick matches that start there, longest
first; a position from which no continuation was found is marked in a bitfield and never tried again. Texts are cut
where no piece can reach across (before a space mark that follows another character, around characters that no piece
holds), so each different stretch is encoded once for each cache lifetime.

Null and empty texts have no tokens and decode to the empty text. Extra columns are ignored; repeated rows give
repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.arrow import keep, texts, tidied, trim

MARK = "▁"
CACHE = 200_000
LOWEST = float("-inf")
LOSSY = "!"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Generations:
    """A cache of two generations: entries that are used move on, the rest go when the younger one is full."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def put(self, key, value):
        if len(self.young) >= self.size:
            self.young, self.old = {}, self.young
        self.young[key] = value
        return value

    def get(self, key):
        if (v := self.young.get(key)) is None and (v := self.old.get(key)) is not None:
            self.put(key, v)
        return v


class Bpe:
    """The encoder and decoder of one model (BPE with byte fallback or an unknown piece, identity normalization)."""

    def __init__(self, model: bytes, cache: int = CACHE):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.sp = sp
        n = sp.get_piece_size()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        self.special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.byte = {i: int(self.piece[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        self.of_byte = {b: i for i, b in self.byte.items()}
        self.id = {p: i for i, p in enumerate(self.piece) if not self.special[i] and i not in self.byte}
        self.own = {p: p for p in self.id}
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        self.unknown = sp.unk_id()
        if sp.normalize("a  b ") != f"{MARK}a{MARK}{MARK}b{MARK}":
            raise ValueError("only identity normalization with a dummy prefix is supported")
        self.pairs: Generations = Generations(300_000)
        self.chains: dict[str, tuple[list[str], list[str]]] = {}
        self.matcher = ahocorasick.Automaton()
        for p in self.id:
            if len(p) == 1 or self.merge(p) == [p]:
                self.matcher.add_word(p, len(p))
        self.matcher.make_automaton()
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if k == 1 or p[:k] in self.matcher), None) for p in self.matcher}
        self.shorter = {p: q for p, q in self.shorter.items() if q}
        chars = set("".join(self.id))
        inner = any(MARK in p.lstrip(MARK) for p in self.id)
        lone = "\n" if "\n" not in chars else ""
        self.line = lone
        self.units = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+") if not inner else re.compile(r"(?s).+")
        self.split = not inner
        self.marked, self.bare = Generations(cache), Generations(cache // 4)
        self.inside = {two for p in self.id for two in zip(p, p[1:])}
        self.stretches = Generations(cache)
        self.newline = self._facts("\n") if lone else None

    def merge(self, s: str) -> list[str]:
        """The merge rule itself: always the best-scored neighbours, the leftmost of equals."""
        parts, score = list(s), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                v = score.get(parts[i] + parts[i + 1])
                if v is not None and (best is None or v > best):
                    best, at = v, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edges(self, p: str) -> tuple[list[str], list[str]]:
        """The symbols that stand first, and those that stand last, while the piece is merged from its characters."""
        if (v := self.chains.get(p)) is None:
            parts, score, first, last = list(p), self.score, [p[0]], [p[-1]]
            while len(parts) > 1:
                at = max(range(len(parts) - 1), key=lambda i: (score.get(parts[i] + parts[i + 1], LOWEST), -i))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                if at == 0:
                    first.append(parts[0])
                if at == len(parts) - 1:
                    last.append(parts[-1])
            v = self.chains[p] = (first, last)
        return v

    def fits(self, a: str, b: str) -> bool:
        """Whether the two stay apart when they are merged again; that is clear where no symbols that ever meet at their border form a piece."""
        if (v := self.pairs.get((a, b))) is None:
            score, heads = self.score, self.edges(b)[0]
            meet = any(x + y in score for x in self.edges(a)[1] for y in heads)
            # the key keeps the model's own strings, not parts of texts
            v = self.pairs.put((self.own.get(a, a), self.own.get(b, b)), not meet or self.merge(a + b) == [a, b])
        return v

    def pieces(self, s: str) -> list[str]:
        """The pieces of a stretch, found by backtracking."""
        n = len(s)
        if n < 2:
            return [s] if s else []
        longest = list(range(1, n + 1))
        for end, size in self.matcher.iter(s):
            longest[end - size + 1] = end + 1
        known, shorter = self.pairs.young.get, self.shorter
        failed, path, pos, last, token = bytearray(n // 8 + 1), [], 0, "", s[: longest[0]]
        while True:
            end = pos + len(token)
            if not failed[end >> 3] & 1 << (end & 7) and (not last or ((v := known((last, token))) or v is None and self.fits(last, token))):
                path.append(token)
                if end == n:
                    return path
                pos, last, token = end, token, s[end : longest[end]]
                continue
            while (token := shorter.get(token)) is None:  # nothing shorter: back to the piece before
                failed[pos >> 3] |= 1 << (pos & 7)
                token = path.pop()
                pos -= len(token)
                last = path[-1] if path else ""

    def _stretch(self, s: str) -> str:
        """The ids as text, after LOSSY where they decode to something else than the stretch with spaces for its marks."""
        ids = []
        for p in self.pieces(s):
            i = self.id.get(p)
            if i is not None:
                ids.append(i)
            elif self.of_byte:
                ids.extend(self.of_byte[b] for b in p.encode())
            else:
                ids.append(self.unknown)
        return ("" if self.text(ids) == s.replace(MARK, " ") else LOSSY) + ",".join(map(str, ids))

    def _facts(self, s: str) -> str:
        """The same of a stretch that is cut between characters that stand side by side in no piece; such stretches recur
        more often than words."""
        cuts = [i for i, two in enumerate(zip(s, s[1:]), 1) if two not in self.inside]
        if not cuts:
            return self._stretch(s)
        out, known = [], self.stretches
        for a, b in zip([0, *cuts], [*cuts, len(s)]):
            t = s[a:b]
            out.append(known.get(t) or known.put(t, self._stretch(t)))
        return ",".join(out)

    def text(self, ids: list[int]) -> str:
        """The text of ids without the removal of the dummy prefix."""
        out, pending = [], bytearray()
        for i in ids:
            if i in self.byte:
                pending.append(self.byte[i])
                continue
            if pending:
                out.append(_utf8(bytes(pending)))
                pending.clear()
            if self.special[i]:
                out.append(" ⁇ " if i == self.unknown else "")
            else:
                out.append(self.piece[i].replace(MARK, " "))
        if pending:
            out.append(_utf8(bytes(pending)))
        return "".join(out)

    def _parts(self, text: str) -> list[str]:
        if not text:
            return []
        out, marked, bare = [], self.marked, self.bare

        def slow(w: str) -> str:
            return marked.get(w) or marked.put(w, self._facts(MARK + w))

        text = MARK + text.replace(" ", MARK)
        for k, line in enumerate(text.split(self.line) if self.line else [text]):
            if k:
                out.append(self.newline)
            head, *rest = line.split(MARK)
            if self.split and "" not in rest:
                if head:
                    out.append(bare.get(head) or bare.put(head, self._facts(head)))
                known = marked.young.get
                out += [known(w) or slow(w) for w in rest]
            else:
                out += [self._facts(u) for u in self.units.findall(line)]
        return out

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for ids in self._parts(text or "") for i in ids.replace(LOSSY, "").split(",")]

    def decode(self, ids: list[int]) -> str:
        out, control = self.text(ids), self.special
        head = next((i for i in ids if not control[i] or i == self.unknown), None)
        return out[1:] if head is not None and head != self.unknown and self.piece[head].startswith(MARK) else out

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text)."""
        text = text or ""
        ids = ",".join(self._parts(text))
        if LOSSY in ids:
            ids = ids.replace(LOSSY, "")
            decoded = self.decode([int(i) for i in ids.split(",")])
        else:  # each stretch decodes to itself
            decoded = text.replace(MARK, " ")
        return ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def _utf8(b: bytes) -> str:
    """Bytes that aren't UTF-8 become one replacement character each."""
    out, i = [], 0
    while i < len(b):
        for n in (1, 2, 3, 4):
            try:
                out.append(b[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


_models: dict[bytes, Bpe] = {}


def encoder(model: bytes, cache: int = CACHE) -> Bpe:
    """One encoder for each worker process, so that its cache lives on from task to task."""
    key = hashlib.sha256(model).digest() + str(cache).encode()
    if key not in _models:
        _models.clear()
        _models[key] = Bpe(model, cache)
    keep("sentencepiece", _models.clear)
    return _models[key]


def token_digests(docs: DataFrame, model: bytes, cache: int = CACHE) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text. cache: how many stretches a worker remembers; it
    changes time and memory, not the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(model, cache)
        for b in batches:
            rows = [bpe.digest(t.as_py()) for t in b.column(1)]
            n, i, d = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            del b, rows, n, i, d
            trim()

    return texts(docs).mapInArrow(tidied("sentencepiece", run), SCHEMA)


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, ids array<int>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(model)
        for b in batches:
            for a in range(0, len(b), 256):
                part = b.slice(a, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([bpe.encode(t.as_py()) for t in part.column(1)], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return texts(docs).mapInArrow(tidied("sentencepiece", run), "doc_id long, ids array<int>")


def decode(ids: DataFrame, model: bytes) -> DataFrame:
    """doc_id, text of a DataFrame with doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(i or []) for i in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(tidied("sentencepiece", run), "doc_id long, text string")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_bytes(public_tokenizers.path("piece_bpe_32k.model")))
