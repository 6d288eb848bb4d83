"""The points-to rules in the memory of one task, for fact tables of a checked size.

Difference propagation over a graph of places: a place is a (context, variable) or a field of an object, and an edge
carries objects from one to the other. The rules, strata and results are those of `pointsto`, which goes on by shuffles
where the facts, or what follows from them, are more than one task may hold.
"""

from __future__ import annotations

import re
from collections import defaultdict

_SLOT = re.compile(r"SpringBeanAlloc:(.*)\.([^.]*)", re.S)


class TooLarge(Exception):
    """More rows follow from the facts than one task may hold."""


def arity(params: str) -> int:
    return len(params.split(",")) if params.strip(" ") else 0


def strip_signature(name: str) -> str:
    return name.split("(", 1)[0]


def signature(name: str | None) -> str:
    """The text between the first and the last bracket of a method's name."""
    if name is None or "(" not in name:
        return ""
    text = name[name.index("(") + 1 :]
    return text[: text.rindex(")")] if ")" in text else ""


class Hierarchy:
    """Ancestors by distance, and dispatch: declarations as (method_fqn, class_fqn, method_name, params)."""

    def __init__(self, parents: list[tuple], declarations: list[tuple]):
        self.parents, self.declared, self._answers = defaultdict(set), defaultdict(list), {}
        for child, parent in parents:
            if child is not None and parent is not None:
                self.parents[child].add(parent)
        self.by_arity: dict[tuple, str] = {}
        for method, cls, name, params in declarations:
            if None in (method, cls, name):
                continue
            if params is not None:
                self.declared[cls, name].append((method, params, arity(params)))
            key = (cls, name, arity(signature(method)))
            self.by_arity[key] = min(method, self.by_arity.get(key, method))

    def distances(self, cls: str) -> dict[str, int]:
        dist, ring = {cls: 0}, [cls]
        while ring:
            following = []
            for c in ring:
                for p in self.parents.get(c, ()):
                    if p not in dist:
                        dist[p] = dist[c] + 1
                        following.append(p)
            ring = following
        return dist

    def dispatch(self, cls: str, name: str, sig: str) -> str | None:
        key = (cls, name, sig)
        if key not in self._answers:
            n, best = arity(sig), None
            for ancestor, d in self.distances(cls).items():
                for method, params, count in self.declared.get((ancestor, name), ()):
                    if params == sig or count == n:
                        rank = (params != sig, d, method)
                        best = rank if best is None or rank < best else best
            self._answers[key] = best and best[2]
        return self._answers[key]

    def refined(self, static: str) -> str:
        """The declared method of the same class, name and number of parameters, the smallest; else the name itself."""
        owner, _, name = strip_signature(static).rpartition(".")
        return self.by_arity.get((owner, name, arity(signature(static))), static) if "(" in static and owner else static


class Worklist:
    """One run. `most` bounds the points-to, field and edge rows together; going past it raises TooLarge."""

    def __init__(self, facts: dict[str, list[tuple]], sensitive: bool, supers: set[str], handled: set[str], most: int):
        self.sensitive, self.supers, self.most, self.size = sensitive, supers, most, 0
        self.hierarchy = Hierarchy(facts["hierarchy"], facts["declarations"])
        self.class_of: dict[str, str] = {}
        for alloc, cls in facts["allocations"]:
            if alloc is not None and cls is not None:
                self.class_of[alloc] = min(cls, self.class_of.get(alloc, cls))
        self.allocs_of = defaultdict(list)
        for alloc, cls in self.class_of.items():
            self.allocs_of[cls].append(alloc)
        self.args, self.summaries = defaultdict(list), defaultdict(set)
        for call, index, var in facts["arguments"]:
            if var is not None and index is not None:
                self.args[call].append((int(index), var))
        for method, index in facts["summaries"]:
            self.summaries[method].add(int(index))
        self.assigned, self.calls = defaultdict(list), defaultdict(list)
        for lhs, rhs, kind, method in facts["assignments"]:
            if lhs is not None and rhs is not None:
                self.assigned[method].append((lhs, rhs, kind))
        for call, method, receiver, name, lhs, static in facts["calls"]:
            if call not in handled:
                self.calls[method].append((call, method, receiver, name, lhs, static, signature(static)))
        self.places: dict[tuple, int] = {}
        self.names: list[tuple] = []
        self.objects: dict[tuple, int] = {}
        self.object_names: list[tuple] = []
        self.held: list[set[int]] = []
        self.after: list[set[int]] = []
        self.uses: list[list] = []  # what waits for the objects of a place: reads, writes and calls
        self.fresh: dict[int, set[int]] = {}
        self.active: set[tuple] = set()
        self.live: dict[tuple, tuple] = {}
        self.resolved: set[tuple] = set()
        self.edges: set[tuple] = set()
        for method in facts["methods"]:
            self.activate(method, "")

    def place(self, *name) -> int:
        at = self.places.get(name)
        if at is None:
            at = self.places[name] = len(self.names)
            self.names.append(name)
            self.held.append(set())
            self.after.append(set())
            self.uses.append([])
            slot = _SLOT.fullmatch(name[1]) if len(name) == 2 else None
            if slot:
                # what is injected into a field slot is in that field of every object of the class
                for alloc in self.allocs_of.get(slot[1], ()):
                    self.flow(at, self.place(self.object("", alloc), slot[2], "field"))
        return at

    def object(self, context: str, alloc: str) -> int:
        at = self.objects.get((context, alloc))
        if at is None:
            at = self.objects[context, alloc] = len(self.object_names)
            self.object_names.append((context, alloc))
        return at

    def put(self, at: int, objects: set[int]) -> None:
        new = objects - self.held[at]
        if new:
            self.held[at] |= new
            self.grow(len(new))
            self.fresh.setdefault(at, set()).update(new)

    def grow(self, n: int) -> None:
        self.size += n
        if self.size > self.most:
            raise TooLarge

    def flow(self, a: int, b: int) -> None:
        if a != b and b not in self.after[a]:
            self.after[a].add(b)
            if self.held[a]:
                self.put(b, self.held[a])

    def use(self, at: int, what: tuple) -> None:
        self.uses[at].append(what)
        if self.held[at]:
            self.meet(what, self.held[at])

    def meet(self, what: tuple, objects: set[int]) -> None:
        kind = what[0]
        if kind == "read":
            for o in tuple(objects):
                self.flow(self.place(o, what[1], "field"), what[2])
        elif kind == "write":
            for o in tuple(objects):
                self.flow(what[2], self.place(o, what[1], "field"))
        else:
            _, context, call = what
            classes = {self.class_of.get(self.object_names[o][1]) for o in objects}
            for cls in classes - {None}:
                target = self.hierarchy.dispatch(cls, call[3], call[6]) if call[3] is not None else None
                if target is not None:
                    self.resolve(context, call, target, 1)

    def activate(self, method: str, context: str) -> None:
        if (method, context) in self.active:
            return
        self.active.add((method, context))
        for lhs, rhs, kind in self.assigned.get(method, ()):
            if kind == "ALLOC":
                self.put(self.place(context, lhs), {self.object(context, rhs)})
            elif kind == "COPY":
                self.flow(self.place(context, rhs), self.place(context, lhs))
            elif kind in ("FIELD_READ", "FIELD_WRITE"):
                expr, var = (rhs, lhs) if kind == "FIELD_READ" else (lhs, rhs)
                base, field = field_parts(expr)
                if base is not None:
                    self.use(self.place(context, base), ("read" if kind == "FIELD_READ" else "write", field, self.place(context, var)))
        for call in self.calls.get(method, ()):
            self.live[call[0], context] = call
            if call[2] is not None:
                self.use(self.place(context, call[2]), ("call", context, call))

    def resolve(self, context: str, call: tuple, target: str, virtual: int) -> None:
        key = (call[0], context, target, virtual)
        if key in self.resolved:
            return
        self.resolved.add(key)
        name, caller, receiver, _, lhs, _, _ = call
        inner = name if self.sensitive and context == "" else ""
        edge = (context, strip_signature(caller), inner, strip_signature(target), virtual)
        if edge not in self.edges:
            self.edges.add(edge)
            self.grow(1)
        if target in self.supers:
            if lhs is not None:
                self.put(self.place(context, lhs), {self.object("", f"SupernodeReturn:{target}")})
        elif target in self.summaries:
            if lhs is not None:
                for index, var in self.args.get(name, ()):
                    if index in self.summaries[target]:
                        self.flow(self.place(context, var), self.place(context, lhs))
        else:
            if receiver is not None:
                self.flow(self.place(context, receiver), self.place(inner, f"{target}#this"))
            for index, var in self.args.get(name, ()):
                self.flow(self.place(context, var), self.place(inner, f"{target}#p{index}"))
            if lhs is not None:
                self.flow(self.place(inner, f"{target}#return"), self.place(context, lhs))
            self.activate(target, inner)

    def settle(self) -> None:
        """Carry objects on until nothing moves."""
        while self.fresh:
            at, new = self.fresh.popitem()
            for b in tuple(self.after[at]):
                self.put(b, new)
            for what in tuple(self.uses[at]):
                self.meet(what, new)

    def run(self) -> None:
        """Virtual calls to their fixpoint, then static callees of the calls whose receivers hold nothing, and again."""
        while True:
            self.settle()
            before = len(self.resolved)
            silent = [(context, call) for (_, context), call in self.live.items() if call[5] is not None and (call[2] is None or not self.held[self.place(context, call[2])])]
            for context, call in silent:
                self.resolve(context, call, self.hierarchy.refined(call[5]), 0)
            if len(self.resolved) == before:
                return

    def add(self, pts: list[tuple], edges: list[tuple]) -> None:
        """Rows from outside, once all is quiet."""
        for context, var, alloc_context, alloc in pts:
            self.put(self.place(context, var), {self.object(alloc_context, alloc)})
        self.edges.update(edges)
        self.run()

    def rows(self):
        """(kind, columns) of all relations."""
        for name, objects in zip(self.names, self.held, strict=True):
            for o in objects:
                if len(name) == 2:
                    yield "pts", (*name, *self.object_names[o])
                else:
                    yield "fields", (*self.object_names[name[0]], name[1], *self.object_names[o])
        for e in self.edges:
            yield "edges", e
        for a in self.active:
            yield "active", a
        for r in self.resolved:
            yield "resolved", r


class _Hub:
    """A place that stands for all it holds, and what is known of these objects together."""

    def __init__(self, name: int):
        self.name = name
        #: the places of its cycle, and those that hold its name
        self.members: set[int] = set()
        self.holders: set[int] = set()
        self.all: set[int] = set()
        self.new: set[int] = set()
        self.fields: set[str] = set()
        self.classes: set[str] = set()
        self.groups: dict[tuple, _Group] = {}


class _Group:
    """Calls of one name and signature whose receivers hold a hub's objects, and what they may reach."""

    def __init__(self):
        self.targets, self.bodies, self.indexes, self.summed = set(), set(), set(), set()
        self.calls: dict[str, tuple] = {}


class Hubbed(Worklist):
    """A run without call contexts in which cycles of flow that hold many objects get a hub each.

    All places of a cycle hold the same, so rows grow with the square of the program where most objects meet in a few
    cycles. There one place, the hub, keeps the objects, and its name, a number under 0, is carried on as if it were an
    object: a place that holds it holds all of the hub's, and besides only what came on ways around the hub. What waits for
    objects meets a hub once: reads and writes by two places for each field (what any of its objects holds, and what is
    written to all of them), calls by a group for each method name and signature. So the work and what is held stay near
    the size of the program. A hub may be made at any time: `condense` looks for cycles whenever the rows have doubled. Hubs
    whose cycles turn out to be one are merged: a place in two cycles makes both the same.
    """

    #: Rows before the first look for cycles, and objects in a place of a cycle that gets a hub.
    FIRST, MANY = 100_000, 16

    def __init__(self, facts: dict[str, list[tuple]], supers: set[str], handled: set[str], most: int):
        self.before: list[set[int]] = []
        self.hubs: dict[int, _Hub] = {}
        self.member_of: dict[int, _Hub] = {}
        #: pairs of hubs, by name, that share a cycle; and of a merged hub, the one that it went to
        self.twins: list[tuple[int, int]] = []
        self.merged: dict[int, int] = {}
        #: places with a new name of a hub: names go before objects, which then need not be carried
        self.named: list[int] = []
        #: of a place: the hubs that it flows to, and those that it holds
        self.reaching: dict[int, set[int]] = defaultdict(set)
        self.through: dict[int, set[int]] = defaultdict(set)
        self.grouped: dict[str, list[_Group]] = defaultdict(list)
        # before the bound is met
        self.first = self.next_look = min(self.FIRST, most // 8)
        super().__init__(facts, False, supers, handled, most)

    def place(self, *name) -> int:
        at = self.places.get(name)
        if at is None:
            self.before.append(set())
            at = super().place(*name)
            if len(name) == 3:
                for hub in tuple(self.hubs.values()):
                    if name[1] in hub.fields and name[0] in hub.all:
                        self.tie(hub, name[0], name[1])
        return at

    def put(self, at: int, objects: set[int]) -> None:
        hub = self.member_of.get(at)
        new = objects - self.held[at]
        if not new:
            return
        for name in self.through.get(at, ()):
            new -= self.hubs[name].all
        if hub:
            real = {o for o in new if o >= 0}
            hub.all |= real
            hub.new |= real
            self.grow(len(real))
            new -= real
        if new:
            self.held[at] |= new
            self.grow(len(new))
            self.fresh.setdefault(at, set()).update(new)
            names = {o for o in new if o < 0} if self.hubs else ()
            if names:
                self.named.append(at)
                self.through[at] |= names
                for name in names:
                    self.hubs[name].holders.add(at)
                for name in names & self.reaching.get(at, frozenset()):
                    self.join(at, self.hubs[name])

    def flow(self, a: int, b: int) -> None:
        if a != b and b not in self.after[a]:
            self.after[a].add(b)
            self.before[b].add(a)
            for name in tuple(self.reaching.get(b, ())):
                self.reach(a, self.hubs[name])
            if self.held[a]:
                self.put(b, self.held[a])

    def reach(self, at: int, hub: _Hub) -> None:
        """`at` flows to the hub, so all before it does; what also holds the hub's name is in its cycle."""
        todo = [at]
        while todo:
            p = todo.pop()
            if hub.name not in self.reaching[p]:
                self.reaching[p].add(hub.name)
                if hub.name in self.held[p]:
                    self.join(p, hub)
                todo += self.before[p]

    def join(self, at: int, hub: _Hub) -> None:
        """A place of the hub's cycle keeps its objects in the hub."""
        own = self.member_of.get(at)
        if own is None:
            self.member_of[at] = hub
            hub.members.add(at)
            had = {o for o in self.held[at] if o >= 0}
            self.held[at] -= had
            self.grow(-len(had))
            self.put(at, had)
        elif own is not hub:
            self.twins.append((own.name, hub.name))

    def merge(self, a: int, b: int) -> None:
        """Two hubs of one cycle become one: the one whose name fewer places hold goes to the other."""
        while a in self.merged:
            a = self.merged[a]
        while b in self.merged:
            b = self.merged[b]
        if a == b:
            return
        gone, keep = sorted((self.hubs[a], self.hubs[b]), key=lambda hub: len(hub.holders))
        self.merged[gone.name] = keep.name
        del self.hubs[gone.name]
        more = gone.all - keep.all
        keep.all |= more
        keep.new |= more
        self.grow(len(more) - len(gone.all))
        keep.members |= gone.members
        for at in gone.members:
            self.member_of[at] = keep
        # what flows to the one flows to the other
        todo, reached = list(gone.members), []
        while todo:
            p = todo.pop()
            if gone.name in self.reaching[p]:
                self.reaching[p].discard(gone.name)
                self.reaching[p].add(keep.name)
                reached.append(p)
                todo += self.before[p]
        for at in gone.holders:
            self.held[at].discard(gone.name)
            self.grow(-1)
            self.through[at].discard(gone.name)
            if at in self.fresh:
                self.fresh[at].discard(gone.name)
            self.put(at, {keep.name})
        for p in reached:
            if keep.name in self.held[p]:
                self.join(p, keep)
        for field in gone.fields:
            self.all_field(keep, field)
            self.flow(self.shared(gone, "written", field), self.shared(keep, "written", field))
            self.flow(self.shared(keep, "read", field), self.shared(gone, "read", field))
        for g in gone.groups.values():
            for call in g.calls.values():
                self.enter(keep, call)

    def condense(self) -> None:
        """Hubs for the cycles that hold many objects and have none; what a hub's name says is not held beside it."""
        for cycle in self.cycles():
            if not any(p in self.member_of for p in cycle) and max(len(self.held[p]) for p in cycle) >= self.MANY:
                at = max(cycle, key=lambda p: (len(self.after[p]) + len(self.before[p]), -p))
                if not any(o >= 0 for o in self.held[at]):
                    continue
                hub = _Hub(-1 - len(self.hubs) - len(self.merged))
                self.hubs[hub.name] = hub
                self.put(at, {hub.name})
                self.reach(at, hub)
        for at, names in self.through.items():
            for name in names:
                n = len(self.held[at])
                self.held[at] -= self.hubs[name].all
                self.grow(len(self.held[at]) - n)
        self.next_look = 2 * self.size + self.first

    def cycles(self):
        """Sets of two or more places that flow to each other (Tarjan)."""
        order, low, on, stack, n = [0] * len(self.names), [0] * len(self.names), bytearray(len(self.names)), [], 0
        for root in range(len(self.names)):
            if order[root] or not self.after[root]:
                continue
            n += 1
            order[root] = low[root] = n
            stack.append(root)
            on[root] = 1
            path = [(root, iter(self.after[root]))]
            while path:
                p, rest = path[-1]
                for b in rest:
                    if not order[b]:
                        n += 1
                        order[b] = low[b] = n
                        stack.append(b)
                        on[b] = 1
                        path.append((b, iter(self.after[b])))
                        break
                    if on[b] and order[b] < low[p]:
                        low[p] = order[b]
                else:
                    path.pop()
                    if path and low[p] < low[path[-1][0]]:
                        low[path[-1][0]] = low[p]
                    if low[p] == order[p]:
                        cycle = []
                        while not cycle or cycle[-1] != p:
                            cycle.append(stack.pop())
                            on[cycle[-1]] = 0
                        if len(cycle) > 1:
                            yield cycle

    def meet(self, what: tuple, objects: set[int]) -> None:
        for hub in [self.hubs[o] for o in objects if o < 0]:
            if what[0] == "call":
                self.enter(hub, what[2])
                continue
            self.all_field(hub, what[1])
            if what[0] == "read":
                self.flow(self.shared(hub, "read", what[1]), what[2])
            else:
                self.flow(what[2], self.shared(hub, "written", what[1]))
        super().meet(what, {o for o in objects if o >= 0})

    def shared(self, hub: _Hub, *what) -> int:
        """A place of the hub's own: a field of any of its objects ("read") or of all ("written"), or a group's this,
        arguments and return."""
        return self.place("hub", hub.name, *what, "")

    def all_field(self, hub: _Hub, field: str) -> None:
        if field not in hub.fields:
            hub.fields.add(field)
            self.flow(self.shared(hub, "written", field), self.shared(hub, "read", field))
            for o in tuple(hub.all):
                self.tie(hub, o, field)

    def tie(self, hub: _Hub, o: int, field: str) -> None:
        """The field of one of the hub's objects, if it has a place, holds what is written to all and is read with all."""
        at = self.places.get((o, field, "field"))
        if at is not None:
            self.flow(self.shared(hub, "written", field), at)
            self.flow(at, self.shared(hub, "read", field))

    def enter(self, hub: _Hub, call: tuple) -> None:
        """A call whose receiver holds the hub's objects joins the group of its name and signature."""
        name, _, receiver, method, lhs, _, sig = call
        if method is None:
            return
        key = (method, sig)
        if key not in hub.groups:
            hub.groups[key] = _Group()
            for cls in tuple(hub.classes):
                self.target(hub, key, cls)
        g = hub.groups[key]
        if name in g.calls:
            return
        g.calls[name] = call
        self.grouped[name].append(g)
        self.flow(self.place("", receiver), self.shared(hub, *key, "this"))
        if lhs is not None:
            self.flow(self.shared(hub, *key, "return"), self.place("", lhs))
        for index, var in self.args.get(name, ()):
            if index not in g.indexes:
                g.indexes.add(index)
                for target in tuple(g.bodies):
                    self.flow(self.shared(hub, *key, index), self.place("", f"{target}#p{index}"))
            self.flow(self.place("", var), self.shared(hub, *key, index))
            if index in g.summed and lhs is not None:
                self.flow(self.place("", var), self.place("", lhs))

    def target(self, hub: _Hub, key: tuple, cls: str) -> None:
        """What a group's calls reach by the hub's objects of a class."""
        g, target = hub.groups[key], self.hierarchy.dispatch(cls, *key)
        if target is None or target in g.targets:
            return
        g.targets.add(target)
        if target in self.supers:
            self.put(self.shared(hub, *key, "return"), {self.object("", f"SupernodeReturn:{target}")})
        elif target in self.summaries:
            new = self.summaries[target] - g.summed
            g.summed |= new
            for call in tuple(g.calls.values()):
                for index, var in self.args.get(call[0], ()):
                    if index in new and call[4] is not None:
                        self.flow(self.place("", var), self.place("", call[4]))
        else:
            g.bodies.add(target)
            self.flow(self.shared(hub, *key, "this"), self.place("", f"{target}#this"))
            for index in tuple(g.indexes):
                self.flow(self.shared(hub, *key, index), self.place("", f"{target}#p{index}"))
            self.flow(self.place("", f"{target}#return"), self.shared(hub, *key, "return"))
            self.activate(target, "")

    def resolve(self, context: str, call: tuple, target: str, virtual: int) -> None:
        # what a call's group reaches is known
        if not (virtual and any(target in g.targets for g in self.grouped.get(call[0], ()))):
            super().resolve(context, call, target, virtual)

    def following(self) -> tuple[int, set[int]]:
        """A place and what is new in it, without what its hubs' names say."""
        while self.named and self.named[-1] not in self.fresh:
            self.named.pop()
        if self.named:
            at = self.named.pop()
            new = self.fresh.pop(at)
        else:
            at, new = self.fresh.popitem()
        if at in self.member_of:
            return at, {o for o in new if o < 0}
        return at, new.difference(*(self.hubs[name].all for name in self.through.get(at, ())))

    def settle(self) -> None:
        while True:
            while self.fresh or self.twins:
                while self.twins:
                    self.merge(*self.twins.pop())
                if not self.fresh:
                    break
                at, new = self.following()
                for b in tuple(self.after[at]):
                    self.put(b, new)
                for what in tuple(self.uses[at]):
                    self.meet(what, new)
                if self.size > self.next_look:
                    self.condense()
            grown = [hub for hub in self.hubs.values() if hub.new]
            if not grown:
                return
            for hub in grown:
                new, hub.new = hub.new, set()
                for field in tuple(hub.fields):
                    for o in new:
                        self.tie(hub, o, field)
                for cls in {self.class_of.get(self.object_names[o][1]) for o in new} - hub.classes - {None}:
                    hub.classes.add(cls)
                    for key in tuple(hub.groups):
                        self.target(hub, key, cls)

    def rows(self):
        """(kind, columns) of all relations but "active" and "resolved", which only a third stratum reads.

        What is held by way of hubs has kinds of its own, with a number for each combination of hubs: "hub", its objects;
        "hub:pts", places; "hub:fields", fields of objects; "hub:all", a field of each of its objects with an object in it,
        or with another combination ("hub:both"); "hub:edges", callers, whose callees by hubs are "hub:callees".
        """
        combinations: dict[frozenset, str] = {}
        number = lambda names: combinations.setdefault(frozenset(names), str(len(combinations)))
        for name, held in zip(self.names, self.held, strict=True):
            hubs = [o for o in held if o < 0]
            rest = {o for o in held if o >= 0}.difference(*(self.hubs[o].all for o in hubs))
            if len(name) == 2:
                yield from (("pts", (*name, *self.object_names[o])) for o in rest)
                if hubs:
                    yield "hub:pts", (number(hubs), *name)
            elif len(name) == 3:
                base = self.object_names[name[0]]
                yield from (("fields", (*base, name[1], *self.object_names[o])) for o in rest)
                if hubs:
                    yield "hub:fields", (number(hubs), *base, name[1])
            elif len(name) == 5 and name[2] == "written" and name[1] in self.hubs:
                base = number([name[1]])
                yield from (("hub:all", (base, name[3], *self.object_names[o])) for o in rest)
                if hubs:
                    yield "hub:both", (base, name[3], number(hubs))
        for names, n in combinations.items():
            for o in set().union(*(self.hubs[name].all for name in names)):
                yield "hub", (n, *self.object_names[o])
        for n, g in enumerate(g for hub in self.hubs.values() for g in hub.groups.values()):
            yield from (("hub:edges", (str(n), caller)) for caller in {strip_signature(call[1]) for call in g.calls.values()})
            yield from (("hub:callees", (str(n), callee)) for callee in {strip_signature(target) for target in g.targets})
        for e in self.edges:
            yield "edges", e


_FIELD = re.compile(r"([^#]*#[^.]*)\.(.*)", re.S)


def field_parts(expr: str) -> tuple[str | None, str | None]:
    m = _FIELD.fullmatch(expr)
    return (m[1], m[2]) if m else (None, None)
