"""Query texts put together from named blocks, with includes, arguments and loops.

A block begins with a line ``--$ BLOCK name key=value ...`` and lasts until the next one; ``--$ INCLUDE name key=value ...``
puts another block in its place, indented alike; ``--$ FOREACH name var=x list=xs`` puts it there once for each value
of the argument ``xs``, which it sees as ``x``. ``#$`` may stand for ``--$``. ``$x`` and ``${x}`` are arguments; those
that nobody gives stay as they are. Values given to ``build`` go before those of an include, and these before a block's
own; an argument with a block's name replaces that block, by another block of that name or else by text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from string import Template

from pyspark.sql import DataFrame, SparkSession

#: Blocks include each other to this depth at most.
MAX_DEPTH = 7
DIRECTIVE = re.compile(r"(?P<indent>[ ]*)(?:--|#)\$ +(?P<kind>BLOCK|INCLUDE|FOREACH) +(?P<name>[\w-]+)(?P<rest>.*)")


@dataclass(frozen=True)
class Use:
    """Another block in the place of a line."""

    name: str
    indent: str
    arguments: Mapping[str, str]
    is_loop: bool


@dataclass
class Block:
    name: str
    arguments: Mapping[str, str] = field(default_factory=dict)
    body: list[str | Use] = field(default_factory=list)


class BlockTemplate:
    """The blocks of a text."""

    def __init__(self, text: str) -> None:
        self.blocks: dict[str, Block] = {}
        current = Block("")
        for line in text.splitlines():
            found = DIRECTIVE.fullmatch(line.rstrip())
            if found is None:
                if line.strip() not in ("#", "--"):
                    current.body.append(line)
                continue
            arguments = dict(part.split("=", 1) for part in found["rest"].split())
            if found["kind"] == "BLOCK":
                current = self.blocks[found["name"]] = Block(found["name"], arguments)
            else:
                current.body.append(Use(found["name"], found["indent"], arguments, found["kind"] == "FOREACH"))

    @classmethod
    def read(cls, path: str | Path) -> BlockTemplate:
        return cls(Path(path).read_text())

    def build(self, name: str, **values: object) -> str:
        """The block's text with everything put in; an unknown block is empty."""
        return "\n".join(self._lines(name, values, 0))

    def query(self, spark: SparkSession, name: str, tables: Mapping[str, DataFrame], **values: object) -> DataFrame:
        """The result of the block's text as Spark SQL over the named tables."""
        return spark.sql(self.build(name, **values), **tables)

    def _lines(self, name: str, values: Mapping[str, object], depth: int) -> Iterator[str]:
        if depth >= MAX_DEPTH:
            raise RecursionError(f"blocks include each other over {MAX_DEPTH} deep at {name}")
        replaced = values.get(name, name)
        block = self.blocks.get(str(replaced))
        if block is not None:
            yield from self._filled(block.body, {**block.arguments, **values}, depth)
        elif name in values and replaced is not None:
            yield from self._filled(str(replaced).split("\n"), values, depth)

    def _filled(self, body: Iterable[str | Use], values: Mapping[str, object], depth: int) -> Iterator[str]:
        for part in body:
            if isinstance(part, str):
                yield Template(part).safe_substitute(values)
                continue
            known = {**part.arguments, **values}
            for inner in self._rounds(part, known):
                for line in self._lines(part.name, inner, depth + 1):
                    yield part.indent + line if line.strip() else line

    @staticmethod
    def _rounds(use: Use, known: dict[str, object]) -> Iterator[Mapping[str, object]]:
        if not use.is_loop:
            yield known
            return
        variable, values = str(known.pop("var")), known.pop(str(known.pop("list")), ())
        for value in values:
            yield {**known, variable: value}
