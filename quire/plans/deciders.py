"""Who decides about heading candidates: the rules, a chat model behind an HTTP interface, or nobody."""

from __future__ import annotations

import json
import re
import urllib.request
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import decisions
from quire.sources.config import Settings

TRIES = 2
TASK = (
    "You restore the chapter structure of a document. Each item is a line that may be a heading, with its number prefix, formatting and, where known, a level. "
    'Answer with one JSON object {"items": [{"idx": number, "is_title": true or false, "level": 1 to 9 or null}]} with an entry for every idx and no other.'
)
FENCE = re.compile(r"```\w*\s(.*?)```", re.DOTALL)
SAID = "doc_id long, seq int, idx int, is_title boolean, level int"

#: (task, request) to the answer's text.
Chat = Callable[[str, str], str]


def json_object(text: str) -> dict:
    """The JSON object in an answer, in a fence or among other words."""
    fenced = FENCE.search(text)
    body = fenced[1] if fenced else text
    opens, closes = body.find("{"), body.rfind("}")
    if opens < 0 or closes < opens:
        raise ValueError("no JSON object in the answer")
    found = json.loads(body[opens : closes + 1])
    if not isinstance(found, dict):
        raise ValueError("not a JSON object")
    return found


def http_chat(settings: Settings) -> Chat:
    """A chat-completions interface at settings.base_url, at temperature 0."""
    head = settings.authorization or (f"Bearer {settings.api_key}" if settings.api_key else "")
    if not head:
        raise ValueError("an API key or an authorization header is needed in the environment")
    url, model, seconds = settings.base_url.rstrip("/") + "/chat/completions", settings.model, settings.seconds

    def chat(task: str, request: str) -> str:
        body = {"model": model, "temperature": 0, "response_format": {"type": "json_object"}, "messages": [{"role": "system", "content": task}, {"role": "user", "content": request}]}
        call = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": head})
        with urllib.request.urlopen(call, timeout=seconds) as answer:
            return json.load(answer)["choices"][0]["message"]["content"]

    return chat


def _decided(chat: Chat, payloads: list[str], wanted: list[int]) -> list[tuple[int, bool, int | None]]:
    """Decisions about one request, or none if no try gives a valid answer for just its candidates."""
    request = '{"items": [' + ", ".join(payloads) + "]}"
    for _ in range(TRIES):
        try:
            items = json_object(chat(TASK, request))["items"]
            said: dict[int, tuple[int, bool, int | None]] = {}
            for x in items:
                level = x.get("level")
                said.setdefault(int(x["idx"]), (int(x["idx"]), bool(x["is_title"]), None if level is None else int(level)))
            if set(said) == set(wanted):
                return [said[i] for i in wanted]
        except Exception:  # noqa: BLE001, S112: whatever goes wrong with one answer, it is asked for again
            continue
    return []


def model_decisions(chat: Chat, most: int = decisions.CHUNK) -> Callable[[DataFrame], DataFrame]:
    """A decider that asks for each chunk of a document's candidates; a chunk without a valid answer leaves its document to the rules."""

    def ask(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        doc, idx = table["doc_id"][0].as_py(), table["idx"].to_pylist()
        rows = _decided(chat, table["payload"].to_pylist(), idx)
        columns = ([doc] * len(rows), range(len(rows)), [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows])
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32()), strict=True)], ["doc_id", "seq", "idx", "is_title", "level"])

    def decide(candidates: DataFrame) -> DataFrame:
        numbered = decisions.chunks(candidates, most).select("doc_id", F.col("para_index").alias("idx"), "chunk")
        asked = decisions.requests(candidates).join(numbered, ["doc_id", "idx"])
        return asked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("idx").cast("int").alias("idx"), "payload", "chunk").groupBy("doc_id", "chunk").applyInArrow(ask, SAID)

    return decide


def decider(settings: Settings) -> Callable[[DataFrame], DataFrame] | None:
    """What settings.decider names; an unknown name decides nothing, so that levels come from the rules alone."""
    if settings.decider == "rule":
        return decisions.rule_decisions
    if settings.decider == "model":
        return model_decisions(http_chat(settings))
    return None
