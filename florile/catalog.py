"""A catalog: a table bound once to logical fields, so that operators don't depend on its column names."""

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT, MULTI, NUMBER, FLAG = "text", "multi", "number", "flag"


@dataclass(frozen=True)
class Field:
    """kind: text, multi (an array of strings), number or flag."""

    name: str
    kind: str
    column: Column

    def values(self) -> Column:
        """The field as an array of strings without nulls and empty strings; a flag or a number of 0 is absent, as in the search language."""
        none = F.array().cast("array<string>")
        if self.kind == MULTI:
            return F.coalesce(F.filter(self.column, lambda x: x.isNotNull() & (x != "")), none)
        text = self.column.cast("string")
        there = self.column.isNotNull() & (self.column != 0 if self.kind == NUMBER else self.column if self.kind == FLAG else text != "")
        return F.when(there, F.array(text)).otherwise(none)

    def text(self) -> Column:
        """The field as one string; absent is empty."""
        return F.coalesce(F.array_join(self.column, " ") if self.kind == MULTI else self.column.cast("string"), F.lit(""))


@dataclass(frozen=True)
class Catalog:
    """rows, with an id, an order of arrival and a name (the last keys of every sort), and the fields by name."""

    rows: DataFrame
    id: str
    fields: Mapping[str, Field]
    seq: str = ""
    name: str = ""
    haystack: tuple[str, ...] = field(default=())
    custom: Column | None = None

    def __getitem__(self, name: str) -> Field:
        """A field; custom.KEY is the text of that key (in its own case) in the map of custom fields."""
        if self.custom is not None and name.lower().startswith("custom."):
            return Field(name, TEXT, F.try_element_at(self.custom, F.lit(name[len("custom.") :])))
        return self.fields[name.lower()]

    def __contains__(self, name: str) -> bool:
        return name.lower() in self.fields or (self.custom is not None and name.lower().startswith("custom."))

    def where(self, condition: Column) -> "Catalog":
        return Catalog(self.rows.where(condition), self.id, self.fields, self.seq, self.name, self.haystack, self.custom)


def bind(rows: DataFrame, id: str, text: Mapping[str, str] | None = None, multi: Mapping[str, Column | str] | None = None, number: Mapping[str, str] | None = None, flag: Mapping[str, str] | None = None, seq: str = "", name: str = "", haystack: tuple[str, ...] = (), custom: Column | str | None = None) -> Catalog:
    """Bind logical names to columns (or expressions over them), by kind. custom: a map from text to text, whose keys are fields custom.KEY."""
    fields: dict[str, Field] = {}
    for kind, own in ((TEXT, text), (MULTI, multi), (NUMBER, number), (FLAG, flag)):
        for k, c in (own or {}).items():
            fields[k.lower()] = Field(k.lower(), kind, F.col(c) if isinstance(c, str) else c)
    return Catalog(rows, id, fields, seq or id, name or id, haystack or tuple(k for k, f in fields.items() if f.kind in (TEXT, MULTI)), F.col(custom) if isinstance(custom, str) else custom)


def twin(many: Column, one: Column) -> Column:
    """The array where it is not null (an emptied one hides the scalar), else the scalar as an array."""
    return F.coalesce(many, F.when(one.isNotNull() & (one != ""), F.array(one)), F.array().cast("array<string>"))
