"""Export shapes as items. Each parser takes a file's path and bytes and yields item dicts, see operators.merge.

An unknown key is kept: on the conversation, the response, or the item. Bytes are parsed in one go: these are single documents, not lines.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import sqlite3
import tomllib
from collections.abc import Iterator
from typing import Any

from ..errors import SourceError

Item = dict[str, Any]


def stringify_id(x: Any) -> str | None:
    if isinstance(x, str):
        return x or None
    if isinstance(x, bool) or x is None:
        return None
    if isinstance(x, int):
        return str(x)
    return f"{x:.0f}" if isinstance(x, float) and math.isfinite(x) and x == int(x) else None


def _load(path: str, data: bytes) -> Any:
    try:
        return json.loads(data.decode("utf-8-sig"))
    except ValueError as e:
        raise SourceError(f"{path}: {e}") from None


def _response(_id: Any, sender: Any, message: Any, time: Any = None, **rest: Any) -> dict:
    own = {"_id": _id, "sender": sender, "message": message, "create_time": time} | rest
    return {"response": {k: v for k, v in own.items() if v is not None}}


def _conversation(_id: Any, title: Any = None, **rest: Any) -> dict:
    return {k: v for k, v in ({"id": _id, "title": title} | rest).items() if v is not None}


def assistant_dump(path: str, data: bytes) -> Iterator[Item]:
    """{conversations: [{conversation, responses}], ...}; ids of conversations may be under id or conversation_id."""
    root = _load(path, data)
    for x in root.get("conversations") or []:
        conv = {k: v for k, v in (x.get("conversation") or {}).items() if v is not None}
        yield {**x, "conversation": conv, "responses": x.get("responses") or []}


def dump_tables(path: str, data: bytes) -> dict[str, list]:
    """media_posts, projects and tasks of an assistant dump, and its other keys as extra."""
    root = _load(path, data)
    known = {k: root.get(k) or [] for k in ("media_posts", "projects", "tasks")}
    return known | {"extra": [{k: v for k, v in root.items() if k not in (*known, "conversations")}]}


#: Kinds that are kept as they are beside the conversations: never shown by a report.
OPAQUE = ("auth", "billing")


def opaque(path: str, data: bytes) -> Iterator[Item]:
    """A file of accounts or payments, whole."""
    yield _load(path, data)


def session_lines(path: str, data: bytes) -> Iterator[Item]:
    """One JSON object a line: type is the sender, content the message."""
    responses = []
    for no, line in enumerate(data.decode("utf-8", "replace").split("\n"), 1):
        if line.strip():
            try:
                x = json.loads(line)
            except ValueError as e:
                raise SourceError(f"{path}, line {no}: {e}") from None
            rest = {k: v for k, v in x.items() if k not in ("_id", "id", "type", "content", "model", "model_id")}
            responses.append(_response(x.get("_id", x.get("id")), x.get("type"), x.get("content"), model=x.get("model") or x.get("model_id"), **rest))
    name = path.rstrip("/").split("/")
    yield {"conversation": _conversation(name[-2] if name[-1] == "chat_history.jsonl" and len(name) > 1 else name[-1].rsplit(".", 1)[0]), "responses": responses}


def overlay_summary(item: Item, summary: dict) -> Item:
    """A session's summary.json gives id, title and summary; what else it has stays on the conversation."""
    own = {k: v for k, v in summary.items() if k not in ("generated_title", "session_summary")}
    own |= {k: v for k, v in (("title", summary.get("generated_title") or summary.get("title")), ("summary", summary.get("session_summary"))) if v}
    return item | {"conversation": item["conversation"] | own}


def _flat(x: Any) -> str:
    if isinstance(x, str):
        return x
    if isinstance(x, list):
        return "".join(map(_flat, x))
    return _flat(x.get("text")) if isinstance(x, dict) else ""


def messenger(path: str, data: bytes) -> Iterator[Item]:
    """A chat, or an account's chats.list and left_chats.list. Text is a string, or an array of strings and entities."""
    root = _load(path, data)
    chats = [root] if "messages" in root else [c for k in ("chats", "left_chats") for c in (root.get(k) or {}).get("list") or []]
    if not chats and "chats" not in root and "left_chats" not in root:
        raise SourceError(f"{path}: neither a chat nor an account's chats")
    for c in chats:
        responses = []
        for m in c.get("messages") or []:
            rest = {k: v for k, v in m.items() if k not in ("id", "from", "date")}
            responses.append(_response(stringify_id(m.get("id")), m.get("from") or m.get("actor"), _flat(m.get("text")) or None, m.get("date"), **rest))
        yield {"conversation": _conversation(stringify_id(c.get("id")), c.get("name"), **{k: v for k, v in c.items() if k not in ("id", "name", "messages")}), "responses": responses}


def message_order(mapping: dict[str, dict], current: str | None) -> list[str]:
    """Nodes from the root to the current one (else the leaf with the greatest key), then those not on the way, by key."""
    if current not in mapping:
        leaves = [k for k, n in mapping.items() if not n.get("children")]
        current = max(leaves or mapping, default=None)
    way: list[str] = []
    seen: set[str] = set()
    while current in mapping and current not in seen:
        seen.add(current)
        way.append(current)
        current = mapping[current].get("parent")
    return way[::-1] + sorted(k for k in mapping if k not in seen)


def _content(x: Any) -> str | None:
    if isinstance(x, str):
        return x or None
    if not isinstance(x, dict):
        return None
    if isinstance(x.get("parts"), list):
        return "".join(p if isinstance(p, str) else p.get("text") or "" if isinstance(p, dict) else "" for p in x["parts"]) or None
    return x.get("text") if isinstance(x.get("text"), str) else None


def mapping_tree(path: str, data: bytes) -> Iterator[Item]:
    """[{title, mapping, current_node, ...}]: a tree of messages for each conversation."""
    root = _load(path, data)
    for x in root if isinstance(root, list) else [root]:
        mapping, responses = x.get("mapping") or {}, []
        for key in message_order(mapping, x.get("current_node")):
            m = mapping[key].get("message")
            if m:
                author = m.get("author")
                sender = author.get("role") if isinstance(author, dict) else author
                rest = {k: v for k, v in m.items() if k not in ("id", "author", "content", "create_time")}
                responses.append(_response(m.get("id") or key, sender, _content(m.get("content")), m.get("create_time"), **rest))
        rest = {k: v for k, v in x.items() if k not in ("id", "conversation_id", "title", "create_time", "mapping")}
        yield {"conversation": _conversation(stringify_id(x.get("conversation_id")) or stringify_id(x.get("id")), x.get("title"), create_time=x.get("create_time"), **rest), "responses": responses}


def _strings(x: Any) -> Iterator[str]:
    if isinstance(x, str):
        yield x
    elif isinstance(x, list):
        for y in x:
            yield from _strings(y)
    elif isinstance(x, dict):
        for y in x.values():
            yield from _strings(y)


def activity_tree(path: str, data: bytes, first: int = 0) -> Iterator[Item]:
    """Posts and messages of a social network's download: an array of items, or one object. ``first`` is the place of the first item."""
    root = _load(path, data)
    for k, x in enumerate(root if isinstance(root, list) else [root], first):
        if not isinstance(x, dict):
            continue
        own = stringify_id(x.get("id")) or stringify_id(x.get("timestamp")) or str(k)
        responses = []
        for m in x.get("messages") or []:
            at = m.get("timestamp_ms", m.get("timestamp"))
            responses.append(_response(stringify_id(at), m.get("sender_name"), m.get("content"), at, **{a: b for a, b in m.items() if a not in ("sender_name", "content")}))
        body = [x["content"]] if isinstance(x.get("content"), str) else []
        body += ["\n".join(s for s in _strings(x["data"]) if s)] if x.get("data") else []
        responses += [_response(stringify_id(x.get("timestamp")), None, b, x.get("timestamp")) for b in body if b]
        yield {"conversation": _conversation(f"{path}#{own}", x.get("title"), create_time=x.get("timestamp"), **{a: b for a, b in x.items() if a not in ("id", "title", "messages", "content", "data", "timestamp")}), "responses": responses}


def assigned_array(path: str, data: bytes) -> Iterator[Item]:
    """A script that assigns an array to a window property: posts, likes and direct messages; other items give nothing."""
    text = data.decode("utf-8", "replace")
    found = re.match(r"\s*window\.[\w.$\[\]\"']+\s*=\s*", text)
    for x in _load(path, (text[found.end() :] if found else text).rstrip().rstrip(";").encode()):
        if "tweet" in x or "full_text" in x:
            t = x.get("tweet", x)
            own = stringify_id(t.get("id_str")) or stringify_id(t.get("id")) or "tweet"
            yield {"conversation": _conversation(own, create_time=t.get("created_at"), **{k: v for k, v in t.items() if k not in ("id", "full_text", "created_at")}), "responses": [_response(own, None, t.get("full_text") or t.get("text"), t.get("created_at"))]}
        elif "like" in x:
            t = x["like"]
            own = stringify_id(t.get("tweetId")) or "like"
            yield {"conversation": _conversation(own, **{k: v for k, v in t.items() if k not in ("tweetId", "fullText")}), "responses": [_response(own, None, t.get("fullText"))]}
        elif "dmConversation" in x:
            t, responses = x["dmConversation"], []
            for m in t.get("messages") or []:
                m = m.get("messageCreate") or {}
                responses.append(_response(stringify_id(m.get("createdAt")) or stringify_id(m.get("id")), m.get("senderId"), m.get("text"), m.get("createdAt"), **{k: v for k, v in m.items() if k not in ("text", "createdAt", "senderId")}))
            yield {"conversation": _conversation(stringify_id(t.get("conversationId")) or "dm"), "responses": responses}


def front_matter(text: str) -> tuple[dict[str, Any], str]:
    """Flat 'key: value' lines between two fences at the top, and the text after them."""
    found = re.match(r"---[ \t]*\r?\n(.*?)(?:^|\n)---[ \t]*(?:\r?\n|$)", text, re.DOTALL | re.MULTILINE)
    if not found:
        return {}, text
    out: dict[str, Any] = {}
    for line in found[1].splitlines():
        if (m := re.match(r"([^\s:#][^:]*):\s*(.*?)\s*$", line)) is not None:
            v = m[2]
            out[m[1].strip()] = None if v in ("", "~", "null") else v == "true" if v in ("true", "false") else v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'" else int(v) if re.fullmatch(r"-?\d{1,18}", v) else v
    return out, text[found.end() :]


def markdown(path: str, data: bytes) -> Iterator[Item]:
    """A note: its path is the id, its first heading (else the file's name) the title, its body the message."""
    try:
        text, lossy = data.decode(), {}
    except UnicodeDecodeError:
        text, lossy = data.decode("utf-8", "replace"), {"utf8_lossy": True}
    extra, body = front_matter(text)
    head = re.search(r"^[ \t]*#{1,6}[ \t]*(\S.*?)[ \t]*#*[ \t]*$", body, re.MULTILINE)
    stem = path.rstrip("/").split("/")[-1].rsplit(".", 1)[0]
    yield {"conversation": _conversation(path, head[1] if head else stem, **{k: v for k, v in extra.items() if k not in ("id", "title")}, **lossy), "responses": [_response(hashlib.sha256(data).hexdigest(), None, body)]}


def _plain(x: Any) -> str | None:
    if isinstance(x, str):
        return x.strip() or None
    return None if x is None or isinstance(x, (list, dict)) else json.dumps(x)


def _keys(x: Any) -> str | None:
    return ", ".join(t for t in map(_plain, x) if t) or None if isinstance(x, list) else _plain(x)


def story_cards(path: str, data: bytes) -> Iterator[Item]:
    n = 0
    for x in _load(path, data):
        title, keys, value = _plain(x.get("title")), _keys(x.get("keys")), _plain(x.get("value"))
        if title and (keys or value):
            n += 1
            yield {"conversation": _conversation(title, title, summary=keys, **{k: v for k, v in x.items() if k not in ("title", "keys", "value")}), "responses": [_response(title, None, value)]}
    if not n:
        raise SourceError(f"{path}: no card with a title and keys or value")


def character(path: str, data: bytes) -> Iterator[Item]:
    try:
        x = tomllib.loads(data.decode())
    except ValueError as e:
        raise SourceError(f"{path}: {e}") from None
    stem = path.rstrip("/").split("/")[-1].rsplit(".", 1)[0]
    title = _plain(x.get("title")) or _plain(x.get("name")) or stem
    rest = {k: v if isinstance(v, (str, int, float, bool, list, dict)) else str(v) for k, v in x.items() if k not in ("id", "title", "keys", "value")}
    own = _plain(x.get("id")) or title
    yield {"conversation": _conversation(own, title, summary=_keys(x.get("keys")), **rest), "responses": [_response(own, None, _plain(x.get("value")))]}


def session_index(path: str, data: bytes) -> Iterator[Item]:
    """A SQLite file with session_docs: a conversation for each row with a session_id, other columns as they are."""
    db = sqlite3.connect(":memory:")
    try:
        db.deserialize(data)
        names = [r[1] for r in db.execute("pragma table_info(session_docs)")]
        if "session_id" not in names:
            raise SourceError(f"{path}: session_docs has no session_id")
        for row in db.execute("select * from session_docs"):
            x = dict(zip(names, row, strict=True))
            own = stringify_id(x["session_id"])
            if own:
                rest = {k: v for k, v in x.items() if k not in ("session_id", "title", "content", "updated_at") and v is not None and not isinstance(v, bytes)}
                yield {"conversation": _conversation(own, x.get("title"), modify_time=x.get("updated_at"), **rest), "responses": [_response(x.get("content_hash") or own, None, x.get("content"))]}
    except sqlite3.DatabaseError as e:
        raise SourceError(f"{path}: {e}") from None
    finally:
        db.close()


PARSERS = {
    "assistant": assistant_dump,
    "session": session_lines,
    "messenger": messenger,
    "mapping": mapping_tree,
    "activity": activity_tree,
    "assigned": assigned_array,
    "markdown": markdown,
    "cards": story_cards,
    "character": character,
    "index": session_index,
    "auth": opaque,
    "billing": opaque,
}


def sniff(path: str, head: bytes) -> str | None:
    """The kind of a file from its name and first bytes; None if no reader takes it."""
    name = path.rstrip("/").split("/")[-1].lower()
    if head.startswith(b"SQLite format 3"):
        return "index"
    if name.endswith(".jsonl"):
        return "session"
    if name.endswith((".md", ".markdown")):
        return "markdown"
    if name.endswith(".toml"):
        return None if name == "cargo.toml" else "character"
    if name.endswith(".js"):
        return "assigned" if head.lstrip().startswith(b"window.") else None
    if not name.endswith(".json"):
        return None
    text = head.decode("utf-8", "ignore")
    if re.search(r"auth[\w-]*\.json$", name):
        return "auth"
    if re.search(r"billing[\w-]*\.json$", name):
        return "billing"
    if re.fullmatch(r"conversations.*\.json", name) and '"mapping"' in text:
        return "mapping"
    if "your_facebook_activity/" in path or "your_instagram_activity/" in path:
        return "activity"
    if '"conversations"' in text and '"conversation"' in text:
        return "assistant"
    if name == "result.json" or '"chats"' in text and '"left_chats"' in text:
        return "messenger"
    if text.lstrip().startswith("[") and '"title"' in text and ('"keys"' in text or '"value"' in text):
        return "cards"
    return None
