"""Verbs: what the words of a query do to a statement.

A verb has up to three roles.  A *filter* gives a predicate over nodes (or None:
no opinion).  A *selector* gives a set of nodes.  A *modifier* changes how
statements are read.  ``BUILDERS`` maps names to verbs.
"""

from __future__ import annotations

import copy
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanforge.functions import names
from spanforge.plans.parser import QueryError, Value, VerbNode
from spanforge.schema import CONTENT, DATA, DIRECTORY, FIELD, FILE, FUNCTION, HAS, MACRO, MODULE, REFS, TYPE, VERB_TYPES

if TYPE_CHECKING:
    from spanforge.plans.statements import Context


class Predicate:
    """A filter tree folded to Columns: one over nodes, one over projects; either may be None."""

    def __init__(self, node: Column | None = None, project: Column | None = None):
        self.node, self.project = node, project

    @property
    def empty(self) -> bool:
        return self.node is None and self.project is None

    @staticmethod
    def both(parts: "list[Predicate | None]") -> "Predicate":
        """AND; parts without an opinion are left out."""
        known = [p for p in parts if p is not None]
        fold = lambda cols: reduce(lambda a, b: a & b, cols) if cols else None
        return Predicate(fold([p.node for p in known if p.node is not None]), fold([p.project for p in known if p.project is not None]))


def either(parts: "list[Column | None]") -> Column | None:
    """OR: one part without an opinion lets everything through; no part at all, nothing."""
    if any(p is None for p in parts):
        return None
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def negate(c: Column | None) -> Column | None:
    return None if c is None else ~c


def name_predicate(pattern: "str | names.Glob") -> Column | None:
    """A bare name: its leaf, or its path if it has separators."""
    if isinstance(pattern, names.Glob):
        return pattern.predicate(True, True)
    if any(c in pattern for c in "./:"):
        return compound_predicate(pattern)
    return F.col("leaf_name") == names.leaf_token(pattern)


def compound_predicate(name: str, anchored: bool = False, dots: bool = True) -> Column | None:
    wanted = names.tokens(name, dots)
    if not wanted:
        return F.col("leaf_name") == names.UNKNOWN if anchored else None
    return names.has_tokens_anchored(F.col("symbol_path"), wanted) if anchored else names.has_tokens(F.col("symbol_path"), wanted)


def pattern_of(value: Value) -> "str | names.Glob":
    return names.Glob(value.text) if value.glob else value.text


def truth(value: Value, what: str) -> bool:
    text = value.plain()
    if text not in ("true", "false"):
        raise ValueError(f"{what} is true or false, not {text!r}")
    return text == "true"


class Verb:
    selects = False  # is a selector
    filters = False  # is a filter
    unit = False
    tag: object = None
    typed = False  # takes the place of the default type filter, and of other typed verbs
    named = False  # constrains the name
    label: str | None = None  # of a labelled statement
    uses: str | None = None  # label that a selector refers to
    layered = False  # makes an overlay layer
    token: str | None = None  # the plain name, for suggestions

    def __init__(self, node: VerbNode):
        self.start, self.end = node.start, node.end

    def inherited(self) -> "Verb | None":
        """What a nested statement gets of this verb."""
        return None

    def add_to(self, verbs: "list[Verb]") -> "list[Verb]":
        return verbs

    def enter(self, ctx: "Context") -> bool:
        """Change the reading context; True if the verb has done its work with that."""
        return False

    @property
    def loose(self) -> bool:
        """A selector that constrains nothing."""
        return self.unit

    def predicate(self) -> Predicate | None:
        return None

    def own_predicate(self) -> Column | None:
        """What a selector adds to the filters of its statement."""
        return None

    def scope_predicate(self, filters: Predicate) -> Predicate | None:
        """The predicate by which neighbours are scoped while this selector isn't resolved."""
        return None


class Unit(Verb):
    selects = unit = True

    def inherited(self) -> Verb:
        return self


class NameSelector(Verb):
    selects = True

    def __init__(self, node: VerbNode):
        super().__init__(node)
        self.pattern = pattern_of(node.named["name"])
        self.token = self.pattern if isinstance(self.pattern, str) else None

    def own_predicate(self) -> Column | None:
        return name_predicate(self.pattern)

    def scope_predicate(self, filters: Predicate) -> Predicate:
        return Predicate.both([filters, Predicate(self.own_predicate())])


class Forced(NameSelector):
    def __init__(self, node: VerbNode):
        if "name" not in node.named:
            raise ValueError("forced needs name=")
        super().__init__(node)
        self.token = None


class Use(Verb):
    selects = True

    def __init__(self, node: VerbNode):
        super().__init__(node)
        if not node.args:
            raise ValueError("use needs a label")
        self.uses = node.args[0].plain()
        self.forced = "forced" in node.named and truth(node.named["forced"], "forced")


class Label(Verb):
    def __init__(self, node: VerbNode):
        super().__init__(node)
        extra = set(node.named) - {"inherit"}
        if extra:
            raise ValueError(f"label has no argument {sorted(extra)[0]!r}")
        if not node.args:
            raise ValueError("label needs a name")
        self.label = node.args[0].plain()
        self.inherit = node.kind == "inherit_label" or ("inherit" in node.named and truth(node.named["inherit"], "inherit"))

    def inherited(self) -> Verb | None:
        return self if self.inherit else None


#: types that a scope after a container shows by default, at top level after a preamble
_SHOWN = {FUNCTION: [FUNCTION], TYPE: [TYPE], FIELD: [FUNCTION], MACRO: [MACRO, FUNCTION], MODULE: [MODULE, FUNCTION], FILE: [FUNCTION, MODULE], DIRECTORY: [DIRECTORY, FILE], DATA: [FUNCTION]}


class TypeSelector(Verb):
    filters = typed = True

    def __init__(self, node: VerbNode):
        super().__init__(node)
        self.type = VERB_TYPES[node.name]
        self.pattern = pattern_of(node.args[0]) if node.args else None
        flag = lambda key: node.named[key].plain().lower() == "true" if key in node.named else None
        wanted = flag("filter")
        self.filter_only = (self.pattern is None) if wanted is None else wanted
        wanted = flag("inherit")
        self.inherit = (self.pattern is None) if wanted is None else wanted
        self.anchored = not (("match" in node.named and node.named["match"].plain() == "contains") or names.dot_separates(self.type))
        self.token = self.pattern if isinstance(self.pattern, str) else None
        self.selects = not (self.filter_only and self.pattern is None and self.inherit)
        self.tag = "type_filter" if self.filter_only and self.pattern is not None else None

    @property
    def loose(self) -> bool:
        return self.filter_only and self.pattern is None

    def inherited(self) -> Verb | None:
        return copy.copy(self) if self.inherit else None

    def add_to(self, verbs: list[Verb]) -> list[Verb]:
        return [v for v in verbs if not v.typed]

    def enter(self, ctx: "Context") -> bool:
        ctx.default_types = list(_SHOWN[self.type])
        return False

    def _name(self) -> Column | None:
        dots = names.dot_separates(self.type)
        if isinstance(self.pattern, names.Glob):
            return self.pattern.predicate(dots, self.anchored)
        if not dots:
            if self.pattern.startswith("/"):
                return F.col("name") == self.pattern
            if any(c in self.pattern for c in "/:"):
                return compound_predicate(self.pattern, self.anchored, False)
            return F.col("leaf_name") == names.leaf_token(self.pattern, False)
        if any(c in self.pattern for c in "./:"):
            return compound_predicate(self.pattern, self.anchored)
        return F.col("leaf_name") == names.leaf_token(self.pattern)

    def predicate(self) -> Predicate:
        if self.filter_only and self.pattern is not None:  # a namespace: the name alone counts
            dots = names.dot_separates(self.type)
            if isinstance(self.pattern, names.Glob):
                return Predicate(self.pattern.predicate(dots, True))
            return Predicate(compound_predicate(self.pattern, False, dots))
        own = F.col("symbol_type") == self.type
        if self.pattern is not None:
            name = self._name()
            own = own if name is None else own & name
        return Predicate(own)

    def scope_predicate(self, filters: Predicate) -> Predicate | None:
        return None if filters.empty else filters


class Select(Verb):
    selects = True
    tag = "select"

    def add_to(self, verbs: list[Verb]) -> list[Verb]:
        return [v for v in verbs if v.tag != self.tag]

    def scope_predicate(self, filters: Predicate) -> Predicate | None:
        return None if filters.empty else filters


class Filter(Verb):
    filters = True

    def __init__(self, node: VerbNode):
        super().__init__(node)
        if len(node.args) < 2:
            raise ValueError("filter needs a kind and a value")
        self.kind = node.args[0].plain()
        self.inherit = "inherit" in node.named and node.named["inherit"].plain().lower() == "true"
        if self.kind == "type":
            self.types = [self._type(part.strip()) for part in node.args[1].plain().split(",")]
        elif self.kind in ("exact_name", "compound_name"):
            self.pattern = pattern_of(node.args[1])
        else:
            raise ValueError(f"filter has no kind {self.kind!r}: type, exact_name and compound_name are")
        self.typed, self.named, self.tag = self.kind == "type", self.kind != "type", ("filter", self.kind)

    @staticmethod
    def _type(name: str) -> int:
        if name not in VERB_TYPES:
            raise ValueError(f"there is no symbol type {name!r}")
        return VERB_TYPES[name]

    def inherited(self) -> Verb | None:
        return self if self.inherit else None

    def add_to(self, verbs: list[Verb]) -> list[Verb]:
        return [v for v in verbs if v.tag != self.tag]

    def enter(self, ctx: "Context") -> bool:
        if self.kind == "type" and self.inherit:
            ctx.default_types = self.types + [FUNCTION] * (FUNCTION not in self.types)
        return False

    def predicate(self) -> Predicate:
        if self.kind == "type":
            return Predicate(either([F.col("symbol_type") == t for t in self.types]))
        if self.kind == "exact_name":
            return Predicate(self.pattern.full_predicate() if isinstance(self.pattern, names.Glob) else F.col("name") == self.pattern)
        return Predicate(self.pattern.predicate(True, True) if isinstance(self.pattern, names.Glob) else compound_predicate(self.pattern))


class DefaultTypes(Verb):
    filters = True

    def __init__(self, node: VerbNode, types: list[int]):
        super().__init__(node)
        self.types = types

    def predicate(self) -> Predicate:
        return Predicate(F.col("symbol_type").isin(self.types))


class Project(Verb):
    filters = True
    tag = "project"

    def __init__(self, node: VerbNode):
        super().__init__(node)
        if not node.args:
            raise ValueError("project needs a name")
        self.project = node.args[0].plain()

    def inherited(self) -> Verb:
        return self

    def add_to(self, verbs: list[Verb]) -> list[Verb]:
        return [v for v in verbs if v.tag != self.tag]

    def predicate(self) -> Predicate:
        return Predicate(None, F.col("project_name") == self.project)


class Ignore(Verb):
    filters = True

    def __init__(self, node: VerbNode):
        super().__init__(node)
        self.pattern = pattern_of(node.args[0]) if node.args else None
        self.package = node.named["package"].plain() if "package" in node.named else None
        if self.pattern is None and self.package is None:
            raise ValueError("ignore needs a name or a package")

    def inherited(self) -> Verb:
        return self

    def predicate(self) -> Predicate:
        parts: list[Column] = []
        if self.pattern is not None:
            own = self.pattern.predicate(True, True) if isinstance(self.pattern, names.Glob) else compound_predicate(self.pattern)
            if own is not None:
                parts.append(own)
        package = names.tokens(self.package) if self.package else []
        if package:
            parts.append(names.below_package(F.col("symbol_path"), package))
        return Predicate(negate(reduce(lambda a, b: a & b, parts)) if parts else None)


class Scope(Verb):
    """``scope``: an empty selection."""

    selects = True

    def __init__(self, node: VerbNode):
        super().__init__(node)
        if node.args:
            raise ValueError("scope has no positional arguments")
        if "isolated" in node.named:
            truth(node.named["isolated"], "isolated")


class Has(Verb):
    relation = HAS

    def enter(self, ctx: "Context") -> bool:
        ctx.relate(self.relation, inherit=True)
        return True


class Refs(Has):
    relation = REFS


class Derive(Verb):
    def __init__(self, node: VerbNode):
        super().__init__(node)
        if "type" not in node.named:
            raise ValueError("derive needs type=")
        self.relation = 0
        for part in node.named["type"].plain().split(","):
            if part.strip() not in ("refs", "has"):
                raise ValueError(f"derive knows refs and has, not {part.strip()!r}")
            self.relation |= REFS if part.strip() == "refs" else HAS
        self.inherit = "inherit" not in node.named or node.named["inherit"].plain().lower() == "true"

    def enter(self, ctx: "Context") -> bool:
        ctx.relate(self.relation, inherit=self.inherit)
        return True


class Unnest(Verb):
    tag = "unnest"


class Any(Verb):
    """``any``: drops inherited types."""

    def add_to(self, verbs: list[Verb]) -> list[Verb]:
        return [v for v in verbs if not v.typed]


class Preamble(Verb):
    def __init__(self, node: VerbNode):
        super().__init__(node)
        if node.args or node.named:
            raise ValueError("preamble has no arguments")

    def enter(self, ctx: "Context") -> bool:
        if ctx.prev is None or ctx.prev.prev is not None:
            raise ValueError("preamble belongs to the first statements of a query")
        ctx.instead = ctx.prev
        return True


class Search(Verb):
    selects = layered = True
    LIMIT = 500

    def __init__(self, node: VerbNode):
        super().__init__(node)
        if len(node.args) != 1:
            raise ValueError("search needs the text to look for")
        self.text = node.args[0].plain()
        if len(self.text) < 3 or not self.text.strip():
            raise ValueError("search needs a text of three characters at least")
        extra = set(node.named) - {"case", "whole_word", "limit"}
        if extra:
            raise ValueError(f"search has no argument {sorted(extra)[0]!r}")
        case = node.named["case"].plain() if "case" in node.named else "smart"
        if case not in ("smart", "sensitive", "insensitive"):
            raise ValueError(f"case is smart, sensitive or insensitive, not {case!r}")
        self.cased = case == "sensitive" or (case == "smart" and names.smart_case(self.text))
        self.whole_word = "whole_word" in node.named and truth(node.named["whole_word"], "whole_word")
        limit = node.named["limit"].plain() if "limit" in node.named else str(self.LIMIT)
        if not limit.isdigit() or int(limit) < 1:
            raise ValueError(f"limit is a positive number, not {limit!r}")
        self.limit = int(limit)


class Loc(Verb):
    selects = layered = True

    def __init__(self, node: VerbNode):
        super().__init__(node)
        if len(node.args) < 2:
            raise ValueError("loc needs a path and a line")
        self.path, line = node.args[0].plain(), node.args[1].plain()
        if not line.isdigit() or int(line) < 1:
            raise ValueError(f"a line is a positive number, not {line!r}")
        self.line = int(line)
        self.project = node.named["project"].plain() if "project" in node.named else None


class Layer(Verb):
    """``layer { ephemeral_.. }``: rows of the request's own."""

    selects = layered = True

    def __init__(self, node: VerbNode):
        super().__init__(node)
        self.rows: list[EphemeralRow] = []

    def enter(self, ctx: "Context") -> bool:
        if ctx.rows is not None:
            raise ValueError("layers are not nested")
        ctx.rows = self.rows
        return False


class EphemeralRow:
    """One ``ephemeral_symbol``, ``ephemeral_instance`` or ``ephemeral_ref``; its symbol may be a label's."""

    FIELDS = {
        "ephemeral_symbol": ("name", "project_id", "symbol_type"),
        "ephemeral_instance": ("symbol_id", "object_id", "start", "end", "instance_type"),
        "ephemeral_ref": ("to_symbol", "from_object", "start", "end"),
    }

    def __init__(self, node: VerbNode):
        self.kind, self.values = node.name, {}
        for key in self.FIELDS[node.name]:
            if key not in node.named:
                raise ValueError(f"{node.name} needs {key}=")
            text = node.named[key].plain()
            if key == "name" or (key in ("symbol_id", "to_symbol") and text.startswith("@")):
                self.values[key] = text
            else:
                try:
                    self.values[key] = int(text)
                except ValueError:
                    raise ValueError(f"{key} is a number, not {text!r}") from None
        if self.kind == "ephemeral_symbol":
            if not FUNCTION <= self.values["symbol_type"] < CONTENT:
                raise ValueError("symbol_type is between 1 and 8")
            scope = node.named["scope"].plain() if "scope" in node.named else None
            self.values["scope"] = int(scope) if scope else None
        if self.kind == "ephemeral_instance" and not 1 <= self.values["instance_type"] <= 10:
            raise ValueError("instance_type is between 1 and 10")

    @property
    def label(self) -> str | None:
        target = self.values.get("symbol_id", self.values.get("to_symbol"))
        return target[1:] if isinstance(target, str) else None


BUILDERS = {
    "select": Select,
    "filter": Filter,
    "ignore": Ignore,
    "project": Project,
    "forced": Forced,
    "scope": Scope,
    "label": Label,
    "use": Use,
    "preamble": Preamble,
    "has": Has,
    "refs": Refs,
    "derive": Derive,
    "unnest": Unnest,
    "any": Any,
    "loc": Loc,
    "search": Search,
    "layer": Layer,
    "_": Unit,
    **{verb: TypeSelector for verb in VERB_TYPES},
}
_SHORT = {"label": Label, "inherit_label": Label, "use": Use, "name": NameSelector, "forced": Forced}


def build(node: VerbNode, in_layer: bool) -> "Verb | EphemeralRow":
    """The verb of a syntax node."""
    try:
        if node.kind == "generic" and node.name in EphemeralRow.FIELDS:
            if not in_layer:
                raise ValueError(f"{node.name} belongs inside layer {{ }}")
            return EphemeralRow(node)
        if in_layer and not (node.kind == "generic" and node.name == "_"):
            raise ValueError("a layer holds ephemeral verbs only")
        if node.kind != "generic":
            return _SHORT[node.kind](node)
        if node.name not in BUILDERS:
            raise ValueError(f"there is no verb {node.name!r}")
        return BUILDERS[node.name](node)
    except ValueError as e:
        raise QueryError(str(e), node.start, node.end) from None
