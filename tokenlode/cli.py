"""python -m tokenlode.cli list CATALOGUE | run | rpc: catalogues, next tokens and generation (for ids, or for text with a tokenizer file; also line by line), a line protocol."""

from __future__ import annotations

import argparse
import random
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .engine import GramEngine
from .sources.corpus import Corpus, catalog


def sample_token(dist: dict[int, float], topk: int, temperature: float, rng: random.Random) -> int:
    """One of the topk most probable (0: of all), weighted by p^(1/T); the most probable at T <= 0, 0 of none."""
    if not dist:
        return 0
    order = sorted(dist.items(), key=lambda x: (-x[1], x[0]))[: topk or None]
    return order[0][0] if temperature <= 0 else rng.choices([t for t, _ in order], [p ** (1 / temperature) for _, p in order])[0]


def answer(engine: GramEngine, line: str) -> str | None:
    """ping | quit | count n ids | prob cont n ids | ntd max_support n ids."""
    try:
        op, *args = line.split()
        nums = [int(x) for x in args]
        if op == "ping":
            return "pong"
        if op == "quit":
            return None
        head, ids = (nums[:1], nums[1:]) if op == "count" else (nums[:2], nums[2:])
        if op not in ("count", "prob", "ntd") or head[-1] != len(ids):
            return "error what is asked isn't understood"
        got = engine.count(ids) if op == "count" else engine.prob(ids, head[0]) if op == "prob" else engine.ntd(ids, head[0])
        if "error" in got:
            return "error " + got["error"]
        if op == "count":
            return f"count {got['count']} {int(got['approx'])}"
        return f"prob {got['prompt_cnt']} {got['cont_cnt']} {got['prob']}" if op == "prob" else f"ntd {got['prompt_cnt']} {int(got['approx'])} {len(got['result_by_token_id'])}"
    except (ValueError, IndexError):
        return "error what is asked isn't understood"


class Words:
    """Text to ids and back with a tokenizer file, if there is one; ids as they are without."""

    def __init__(self, path: str | None):
        if path:
            from tokenizers import Tokenizer

            self.t = Tokenizer.from_file(path)
        else:
            self.t = None

    def ids(self, text: str) -> list[int]:
        return self.t.encode(text, add_special_tokens=False).ids if self.t else [int(x) for x in text.split()]

    def text(self, ids: list[int]) -> str:
        return self.t.decode(ids) if self.t else " ".join(map(str, ids))


def show(e: GramEngine, words: Words, ids: list[int], topk: int, new: int, temperature: float, rng: random.Random) -> None:
    """The prompt with `new` tokens more, each drawn after one look at what follows; or, with none, what may follow."""
    if new:
        out = list(ids)
        for _ in range(new):
            got = e.ntd(out)["result_by_token_id"]
            out.append(sample_token({t: x["prob"] for t, x in got.items()}, topk, temperature, rng))
        print(words.text(out))
        return
    got = e.ntd(ids)["result_by_token_id"]
    for t, x in sorted(got.items(), key=lambda x: (-x[1]["prob"], x[0]))[: topk or None]:
        print(t, x["cont_cnt"], f"{x['prob']:.6f}", *([repr(words.text([t]))] if words.t else []), sep="\t")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tokenlode")
    sub = p.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list").add_argument("path")
    for name in ("run", "rpc"):
        r = sub.add_parser(name)
        r.add_argument("name", nargs="?", help="an entry of the catalogue, for its url and version")
        r.add_argument("--catalogue")
        r.add_argument("--index", nargs="+")
        r.add_argument("--dtype", default="u16")
        r.add_argument("--eos", type=int, default=0)
        if name == "run":
            r.add_argument("--prompt-ids", type=int, nargs="*", default=[])
            r.add_argument("--prompt", help="text, for --tokenizer")
            r.add_argument("--tokenizer", help="a tokenizer's JSON file")
            r.add_argument("--interactive", action="store_true", help="a prompt for each line read")
            r.add_argument("--topk", type=int, default=20)
            r.add_argument("--generate", type=int, default=0)
            r.add_argument("--temperature", type=float, default=1.0)
            r.add_argument("--seed", type=int, default=0)
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.cmd == "list":
        for row in catalog(spark, a.path).orderBy("name").collect():
            print(*row, sep="\t")
        return 0
    index, version = a.index, 4
    if a.name:
        row = catalog(spark, a.catalogue).where(F.col("name") == a.name).first() if a.catalogue else None
        if row is None:
            p.error(f"{a.name} is in no catalogue given")
        index, version = index or [row["url"]], row["version"]
    if not index:
        p.error("--index or an entry of a catalogue is needed")
    e = GramEngine(Corpus.from_folders(spark, index, a.dtype, a.eos), version=version)
    if a.cmd == "rpc":
        for line in sys.stdin:
            if not line.strip():
                continue
            out = answer(e, line)
            if out is None:
                break
            print(out, flush=True)
        return 0
    words, rng = Words(a.tokenizer), random.Random(a.seed)
    if a.interactive:
        for line in sys.stdin:
            try:
                show(e, words, words.ids(line.rstrip("\n")), a.topk, a.generate, a.temperature, rng)
            except (ValueError, KeyError) as x:
                print(f"error {x}", flush=True)
        return 0
    show(e, words, words.ids(a.prompt) if a.prompt is not None else a.prompt_ids, a.topk, a.generate, a.temperature, rng)
    return 0


if __name__ == "__main__":
    sys.exit(main())
