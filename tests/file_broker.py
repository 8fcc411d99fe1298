"""A broker in a folder, for tests: a JSON-lines file a shard."""

import json
import os


class FileBroker:
    def __init__(self, folder: str):
        self.folder = folder

    def _lines(self, shard: str) -> list[dict]:
        with open(f"{self.folder}/{shard}.jsonl") as f:
            return [json.loads(x) for x in f if x.endswith("\n")]

    def put(self, shard: str, value: bytes, key: str | None = None, ms: int | None = None) -> None:
        with open(f"{self.folder}/{shard}.jsonl", "a") as f:
            f.write(json.dumps({"v": value.hex(), "k": key, "t": ms}) + "\n")

    def shards(self) -> list[str]:
        return sorted(f.removesuffix(".jsonl") for f in os.listdir(self.folder) if f.endswith(".jsonl"))

    def bounds(self, shard: str) -> tuple[int, int]:
        return 0, len(self._lines(shard))

    def at_timestamp(self, shard: str, ms: int) -> int:
        lines = self._lines(shard)
        return next((k for k, x in enumerate(lines) if x["t"] is not None and x["t"] >= ms), len(lines))

    def read(self, shard: str, start: int, end: int):
        for k, x in enumerate(self._lines(shard)[start:end]):
            yield start + k, bytes.fromhex(x["v"]), x["k"], x["t"]

    def committed(self, offsets: dict[str, int]) -> None:
        with open(f"{self.folder}/committed.json", "w") as f:
            json.dump(offsets, f)


def file_broker(options: dict[str, str]) -> FileBroker:
    return FileBroker(options["folder"])
