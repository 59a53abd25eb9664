"""Answers from a store: a loop in which a policy picks tools and reads their results.

The tools are Spark queries; the loop is the driver's. A policy gets the
messages so far and gives calls or an answer. The default one goes by keywords
and needs no model.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from quire.plans.ingest import PER_DOCUMENT
from quire.plans.store import Store

#: Words that make the default policy search or find.
SEARCH_WORDS = ("废标", "保证金", "评分")
DEPOSIT, SCORING = "保证金", "评分"
FIND_WORDS = ("在哪", "哪个章节")
STEP_CHARS = 2000


@dataclass(frozen=True)
class Call:
    tool: str
    args: dict
    id: str = ""


@dataclass
class Trace:
    thread: str
    steps: list[dict] = field(default_factory=list)
    answer: str = ""


Policy = Callable[[list[dict]], list[Call] | str]


def keyword_policy(messages: list[dict]) -> list[Call] | str:
    """One tool by the last question's words, then an answer that quotes what it found."""
    asked = max(k for k, m in enumerate(messages) if m["role"] == "user")
    results = [m["content"] for m in messages[asked:] if m["role"] == "tool"]
    if results:
        return "\n".join(r[:400] for r in results)
    question = messages[asked]["content"]
    if any(w in question for w in SEARCH_WORDS):
        return [Call("search_content", {"keywords": DEPOSIT if DEPOSIT in question else SCORING})]
    if any(w in question for w in FIND_WORDS):
        return [Call("find_chapter", {"title_keywords": "评标"})]
    return [Call("get_document_map", {})]


class Tools:
    """The four tools over one document, each with a text as result."""

    def __init__(self, store: Store, doc_id: int, max_chars: int = 4000, top_k: int = 5) -> None:
        self.store, self.doc_id, self.max_chars, self.top_k = store, doc_id, max_chars, top_k

    def get_document_map(self) -> str:
        row = self.store.map(self.doc_id).first()
        return row["map"] if row else f"Document {self.doc_id} has no chapters."

    def get_chapter(self, chapter_id: int, max_chars: int | None = None, offset: int = 0) -> str:
        row = None
        if chapter_id // PER_DOCUMENT == self.doc_id:
            with contextlib.suppress(LookupError):
                row = self.store.page(chapter_id, max_chars or self.max_chars, offset).first()
        if row is None:
            return f"Document {self.doc_id} has no chapter {chapter_id}."
        below = [r["child"] for r in self.store.children(chapter_id).collect()]
        head = f"#{row['id']} (level {row['level']}) {row['chapter_path'] or row['title']}"
        more = [f"(more from offset={row['next_offset']})"] if row["truncated"] else []
        return "\n".join([head, row["page"], *more, *(["below it:", *below] if below else ["nothing below it"])])

    def search_content(self, keywords: str, chapter_id: int | None = None, top_k: int | None = None) -> str:
        if not keywords.split():
            return "Give at least one keyword."
        rows = self.store.search(self.doc_id, keywords, chapter_id, top_k or self.top_k).collect()
        return "\n".join(f"#{r['id']} {r['chapter_path'] or ''}: {r['hit']}" for r in rows) or "Nothing found."

    def find_chapter(self, title_keywords: str) -> str:
        if not title_keywords.split():
            return "Give at least one word of the title."
        rows = self.store.find(self.doc_id, title_keywords).collect()
        return "\n".join(f"{r['id']}|{r['level']}|{r['chapter_path'] or ''}|{r['title']}" for r in rows) or "No chapter has such a title."


def ask(store: Store, doc_id: int, question: str, policy: Policy = keyword_policy, rounds: int = 6, thread: str | None = None) -> Trace:
    """Let the policy use tools for at most `rounds` rounds. A thread that has messages goes on: the policy sees them, and the new ones are logged after them."""
    store.require(doc_id)
    tools, trace = Tools(store, doc_id), Trace(thread or uuid.uuid4().hex)
    earlier = [r.asDict() for r in store.thread(trace.thread).select("role", "content", "call_id").collect()] if thread else []
    opening = [] if earlier else [{"role": "system", "content": tools.get_document_map()}]
    messages = [*earlier, *opening, {"role": "user", "content": question}]
    for _ in range(rounds + 1):
        said = policy(messages)
        if isinstance(said, str):
            trace.answer = said
            break
        calls = [replace(c, id=c.id or uuid.uuid4().hex) for c in said]
        messages.append({"role": "assistant", "content": "", "calls": [c.id for c in calls]})
        results: dict[str, str] = {}
        for call in calls:
            if call.tool not in ("get_document_map", "get_chapter", "search_content", "find_chapter"):
                raise ValueError(f"no tool {call.tool}")
            result = getattr(tools, call.tool)(**call.args)
            messages.append({"role": "tool", "content": result, "call_id": call.id})
            results.setdefault(call.id, result)
        trace.steps += [{"id": c.id, "tool": c.tool, "args": c.args, "result": results[c.id][:STEP_CHARS]} for c in calls]
    store.log(trace.thread, [*messages[len(earlier) :], {"role": "assistant", "content": trace.answer}])
    return trace
