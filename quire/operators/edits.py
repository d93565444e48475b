"""Edit commands that can be taken back, as keyed state over logs and streams.

A document is slots: ``id:name`` with a text or nothing, where id is an element's or 0 for the document. A command becomes assignments to slots, or is refused; what the slots held is kept with it, so taking it back is assignments too.
The same rules run as a fold over a finished log (commands_of) and with a document's slots and commands in map state over a stream (CommandProcessor): only the slots and commands that a step touches are read there.

Slots of a model: kind, alt, decorative, label, label_modified, value, modified, read_only, field_kind, level, role, text, parent, order (an element's children), cells (a row's), mark, contents, edited, in_reply_to; of the document: language,
title, displays_title, fields. Ids of comments that are added are minus the number of the command.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, MutableMapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .fold import fold

#: The commands, and the kinds of elements that they act on (none: the document).
COMMANDS = {
    "AltText": ("Figure",), "Decorative": ("Figure",), "FieldLabel": ("FormField",), "FieldValue": ("FormField",), "HeadingLevel": ("Heading",), "CellRole": ("TableCell",), "HeaderRow": ("TableRow",), "Language": (), "Title": (),
    "Artifact": ("Heading", "Paragraph", "ListItem", "Caption", "BlockQuote", "Code"), "Move": ("Heading", "Paragraph", "List", "ListItem", "Table", "Figure", "Section", "Link", "FormField"), "ResetForm": (), "Sign": ("FormField",),
    "AddAnnotation": ("Heading", "Paragraph", "Figure", "TableCell", "FormField", "Link", "ListItem"), "ReplyAnnotation": ("Annotation",), "EditAnnotation": ("Annotation",), "DeleteAnnotation": ("Annotation",),
}
ROLES = ("Data", "Header", "ColumnHeader", "RowHeader")
#: Slots whose value before a command is that before its last application; of others, it is that before the first.
PLACED = ("order", "parent")
Slots = MutableMapping[str, str | None]


def _ids(text: str | None) -> list[str]:
    return text.split(",") if text else []


def _moved(order: str | None, child: str, place: int) -> str:
    rest = [x for x in _ids(order) if x != child]
    place = max(0, min(place, len(rest)))
    return ",".join([*rest[:place], child, *rest[place:]])


def assignments(kind: str, number: int, target: str, value: str | None, slots: Slots) -> dict[str, str | None] | str:
    """What a command sets, or why it is refused."""
    get = lambda name, of=target: slots.get(f"{of}:{name}")
    if kind not in COMMANDS:
        return "unknown command"
    if COMMANDS[kind] and get("kind") not in COMMANDS[kind]:
        return "wrong target"
    some = (value or "").strip() or None
    parent = get("parent")
    if kind == "AltText":
        return {f"{target}:alt": some, f"{target}:decorative": None}
    if kind == "Decorative":
        return {f"{target}:alt": None, f"{target}:decorative": "1"}
    if kind == "FieldLabel":
        return {f"{target}:label": some, f"{target}:label_modified": "1"}
    if kind == "FieldValue":
        if get("read_only") or get("field_kind") == "PushButton":
            return "read-only"
        if get("field_kind") == "CheckBox" and (value or "") not in ("", "Yes", "Off"):
            return "not a state"
        return {f"{target}:value": value or None, f"{target}:modified": "1"}
    if kind == "HeadingLevel":
        return {f"{target}:level": some} if some in ("1", "2", "3", "4", "5", "6") else "no such level"
    if kind == "CellRole":
        return {f"{target}:role": some} if some in ROLES else "no such role"
    if kind == "HeaderRow":
        return {f"{c}:role": "ColumnHeader" for c in _ids(get("cells"))}
    if kind == "Language":
        return {"0:language": some}
    if kind == "Title":
        return {"0:title": some} | ({"0:displays_title": "1"} if some else {})
    if kind == "ResetForm":
        filled = [f for f in _ids(slots.get("0:fields")) if slots.get(f"{f}:value") and not slots.get(f"{f}:read_only") and slots.get(f"{f}:field_kind") != "PushButton"]
        return {k: v for f in filled for k, v in ((f"{f}:value", None), (f"{f}:modified", "1"))} or "nothing to clear"
    if kind == "Sign":
        return {f"{target}:mark": some} if some else "nothing to draw"
    if kind == "EditAnnotation":
        return {f"{target}:contents": value or "", f"{target}:edited": "1"}
    if parent is None:
        return "not attached"
    order = slots.get(f"{parent}:order")
    if kind == "Artifact":
        return {f"{target}:kind": "Artifact"}
    if kind == "Move":
        return {f"{parent}:order": _moved(order, target, int(some))} if some and some.lstrip("-").isdigit() else "no such place"
    if kind == "DeleteAnnotation":
        return {f"{parent}:order": ",".join(x for x in _ids(order) if x != target), f"{target}:parent": None}
    new = str(-number)
    made = {f"{new}:kind": "Annotation", f"{new}:contents": value or "", f"{new}:parent": parent}
    if kind == "ReplyAnnotation":
        return made | {f"{new}:parent": target, f"{new}:in_reply_to": target, f"{target}:order": _moved(get("order"), new, 1 << 30)}
    place = _ids(order).index(target) + 1 if target in _ids(order) else 1 << 30
    while place < len(_ids(order)) and slots.get(f"{_ids(order)[place]}:kind") == "Annotation":
        place += 1
    return made | {f"{parent}:order": _moved(order, new, place)}


def step(action: str, number: int, kind: str | None, target: str | None, value: str | None, slots: Slots, commands: MutableMapping[int, str]) -> str:
    """One step of a log: 'make' makes a command and applies it, 'apply' and 'revert' act on one that was made. Gives 'done' or why it was refused; then nothing has changed."""
    known = commands.get(number)
    if action == "make":
        if known is not None:
            return "number is taken"
        made = {"kind": kind, "target": target or "0", "value": value, "applied": False, "before": {}}
    elif known is None:
        return "no such command"
    else:
        made = json.loads(known)
    if action == "revert":
        if not made["applied"]:
            return "not applied"
        for slot, old in made["before"].items():
            slots[slot] = old
        made["applied"] = False
        commands[number] = json.dumps(made)
        return "done"
    if made["applied"]:
        return "already applied"
    found = assignments(made["kind"], number, made["target"], made["value"], slots)
    if isinstance(found, dict):
        before = {s: slots.get(s) for s in found if s not in made["before"] or s.split(":")[1] in PLACED}
        made["before"] = {s: before.get(s, made["before"].get(s)) for s in found}
        for slot, new in found.items():
            slots[slot] = new
        made["applied"] = True
    if action == "make" or made["applied"]:
        commands[number] = json.dumps(made)
    return "done" if made["applied"] else found


class _Changed(dict):
    """Slots with what was changed of them."""

    def __init__(self) -> None:
        super().__init__()
        self.loaded: dict[str, str | None] = {}

    def __setitem__(self, slot: str, value: str | None) -> None:
        self.loaded.setdefault(slot, self.get(slot))
        super().__setitem__(slot, value)

    def load(self, slot: str, value: str | None) -> None:
        super().__setitem__(slot, value)


#: seq, number, outcome of each step; slot and value of what differs from the model in the end (seq null).
RESULT = "seq bigint, number int, outcome string, slot string, value string"


def commands_of(model: DataFrame, log: DataFrame) -> DataFrame:
    """What each step of the logs came to, and how the documents stand in the end.

    model: doc_id, slot, value. log: doc_id, seq, action, number, kind, target, value. A document's slots and log are one task's, which holds the slots and the commands made so far.
    """
    none = lambda t: F.lit(None).cast(t)
    rows = model.join(log.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.lit(-1).cast("bigint").alias("seq"), F.col("slot").alias("action"), none("int").alias("number"), none("string").alias("kind"), none("string").alias("target"), "value")
    rows = rows.unionByName(log.select("doc_id", F.col("seq").cast("bigint").alias("seq"), "action", F.col("number").cast("int").alias("number"), "kind", F.col("target").cast("string").alias("target"), "value"))

    def one(state: tuple | None, row: tuple) -> tuple[tuple, Iterable[tuple]]:
        slots, commands = state or (_Changed(), {})
        seq, action, number, kind, target, value = row
        if seq < 0:
            slots.load(action, value)
            return (slots, commands), ()
        return (slots, commands), [(seq, number, step(action, number, kind, target, value, slots, commands), None, None)]

    def end(state: tuple) -> list[tuple]:
        slots = state[0]
        return [(None, None, None, s, slots.get(s)) for s in sorted(slots.loaded) if slots.get(s) != slots.loaded[s]]

    return fold(rows, "doc_id", ["seq", "number", "action"], RESULT, one, end)


class _State(MutableMapping):
    """A map state as a mapping; absent keys and nulls are the same."""

    def __init__(self, state) -> None:
        self.state = state

    def __getitem__(self, key):
        if not self.state.containsKey((key,)):
            raise KeyError(key)
        return self.state.getValue((key,))[0]

    def __setitem__(self, key, value) -> None:
        self.state.updateValue((key,), (value,))

    def __delitem__(self, key) -> None:
        self.state.removeKey((key,))

    def __iter__(self) -> Iterator:
        return (k[0] for k in self.state.keys())

    def __len__(self) -> int:
        return sum(1 for _ in self)


class CommandProcessor(StatefulProcessor):
    """E1, E2 over a stream for transformWithStateInPandas: rows of doc_id, seq, action, number, kind, target, value. A row with action 'load' sets slot ``kind`` to ``value``. Each step gives its outcome; a document's slots and commands are map
    state, of which a step reads what it needs, so state may be far larger than memory."""

    OUTPUT = "doc_id long, seq long, number int, outcome string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getMapState("slots", "slot string", "value string")
        self.commands = handle.getMapState("commands", "number int", "record string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        slots, commands = _State(self.slots), _State(self.commands)
        text = lambda x: None if pd.isna(x) else x
        log = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out = []
        for seq, action, number, kind, target, value in zip(*(log[c].tolist() for c in ("seq", "action", "number", "kind", "target", "value")), strict=True):
            if action == "load":
                slots[kind] = text(value)
            else:
                out.append((key[0], seq, int(number), step(action, int(number), text(kind), text(target), text(value), slots, commands)))
        yield pd.DataFrame(out, columns=["doc_id", "seq", "number", "outcome"])

    def close(self) -> None:
        pass


def model_of(tree: DataFrame) -> DataFrame:
    """doc_id, slot, value of element trees (doc_id, element_id, parent_id, sibling_ord, tag, kind, attrs, text)."""
    a = lambda name: F.try_element_at("attrs", F.lit(name))
    k, some = F.col("kind"), lambda c: F.nullif(F.trim(c), F.lit(""))
    type_ = F.lower(F.coalesce(a("type"), F.lit("text")))
    names: dict[str, Column] = {
        "kind": k, "parent": F.coalesce("parent_id", F.lit(0)).cast("string"), "text": some(F.col("text")), "alt": F.when(k == "Figure", some(a("alt"))), "decorative": F.when((k == "Figure") & (a("alt") == ""), "1"),
        "label": F.when(k == "FormField", F.coalesce(some(a("aria-label")), some(a("title")), some(a("#label")))), "value": F.when(k == "FormField", F.coalesce(some(a("value")), F.when(F.col("tag") == "textarea", some(F.col("text"))))),
        "read_only": F.when((k == "FormField") & a("readonly").isNotNull(), "1"), "field_kind": F.when(k == "FormField", F.when(type_.isin("submit", "button"), "PushButton").when(type_ == "checkbox", "CheckBox").otherwise("Text")),
        "level": F.when(k == "Heading", F.substring("tag", 2, 1)), "role": F.when(k == "TableCell", F.when(F.col("tag") == "th", "ColumnHeader").otherwise("Data")),
    }
    e = tree.filter(~k.isin("Run", "Option"))
    own = e.select("doc_id", F.inline(F.array(*(F.struct(F.concat(F.col("element_id").cast("string"), F.lit(f":{n}")).alias("slot"), v.alias("value")) for n, v in names.items()))))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("element_id")), lambda x: x.cast("string")), ",")
    order = e.groupBy("doc_id", F.coalesce("parent_id", F.lit(0)).alias("p")).agg(ids.alias("value")).select("doc_id", F.concat(F.col("p").cast("string"), F.lit(":order")).alias("slot"), "value")
    cells = e.filter(k == "TableCell").groupBy("doc_id", "parent_id").agg(ids.alias("value")).select("doc_id", F.concat(F.col("parent_id").cast("string"), F.lit(":cells")).alias("slot"), "value")
    fields = e.filter(k == "FormField").groupBy("doc_id").agg(ids.alias("value")).select("doc_id", F.lit("0:fields").alias("slot"), "value")
    facts = e.groupBy("doc_id").agg(F.max(F.when(F.col("tag") == "html", a("lang"))).alias("language"), F.min(F.when(k == "Title", F.struct("element_id", "text")))["text"].alias("title"))
    facts = facts.select("doc_id", F.inline(F.array(*(F.struct(F.lit(f"0:{n}").alias("slot"), some(F.col(n)).alias("value")) for n in ("language", "title")))))
    return own.unionByName(order).unionByName(cells).unionByName(fields).unionByName(facts).filter("value IS NOT NULL")


# ---- Undo and redo ----------------------------------------------------------------------------------------------------------
def history(log: DataFrame) -> DataFrame:
    """Undo and redo over a stack in which every entry points to the one below it, so the state of a document is two pointers and nothing is listed.

    log: doc_id, seq, op. Gives each step's entry (from 1; the one made, undone or redone), below (the entry it stands on) and top (the entry that stands on top after it; 0: none), and refused, with nothing to undo or redo. What was undone is gone
    once something new is done. A document's log streams past; its task holds one pointer an entry.
    """
    rows = log.select("doc_id", F.col("seq").cast("bigint").alias("seq"), "op")

    def one(state: list | None, row: tuple) -> tuple[list, list[tuple]]:
        state = state or [0, 0, {}, {}]  # top, made, below by entry, redo by entry: what was undone onto it
        top, made, below, above = state
        seq, op = row
        if op == "undo":
            if not top:
                return state, [(seq, None, None, top, True)]
            state[0] = below[top]
            above[state[0]] = top
            return state, [(seq, top, below[top], state[0], False)]
        if op == "redo":
            back = above.pop(top, None)
            if back is None:
                return state, [(seq, None, None, top, True)]
            state[0] = back
            return state, [(seq, back, top, back, False)]
        state[1] = made + 1
        below[made + 1], state[0] = top, made + 1
        above.clear()
        return state, [(seq, made + 1, top, made + 1, False)]

    return fold(rows, "doc_id", ["seq"], "seq bigint, entry int, below int, top int, refused boolean", one, _nothing)


def _nothing(_: object) -> Iterable[tuple]:
    return ()


