"""Fields of one JSON log line, probed on a VARIANT that is parsed once per line."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweir import patterns as P
from logweir.functions.levels import normalize_level, numeric_level
from logweir.functions.numbers import float_prefix, int_prefix
from logweir.functions.text import strip
from logweir.functions.times import epoch_time, general_time

_NUMBER = r"^-?\d+(?:\.\d+)?(?:E-?\d+)?$"
_FALSY = r"^(?:-?0(?:\.0+)?|false)?$"


def wrapped_json(text: Column) -> Column:
    """``text`` as the only element of a JSON array, parsed; NULL if it is not valid JSON.

    The parser itself stops after the first complete value and would let text behind it
    pass. Inside brackets the rest has to be valid as well.
    """
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))


def is_single_value(text: Column, wrapped: Column) -> Column:
    """Whether ``text`` is one JSON value. A bracket in it could close the wrapping early,
    so such a text is parsed a second time within another pair."""
    other = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))
    not_closed_early = F.when(text.contains("]"), other.isNotNull()).otherwise(True)
    alone = F.try_variant_get(wrapped, "$[1]", "variant").isNull()
    return wrapped.isNotNull() & alone & not_closed_early


def is_json(text: Column) -> Column:
    """Whether a stripped line is a valid JSON object or array."""
    shaped = (text.startswith("{") & text.endswith("}")) | (
        text.startswith("[") & text.endswith("]")
    )
    return F.when(shaped, is_single_value(text, wrapped_json(text))).otherwise(False)


def _schema(names: Sequence[str]) -> str:
    """Struct type with a VARIANT per field; dotted names give nested structs."""
    inner: dict[str, list[str]] = {}
    for name in names:
        head, _, rest = name.partition(".")
        inner.setdefault(head, []).extend([rest] if rest else [])
    fields = (f"`{n}`: {_schema(sub) if sub else 'variant'}" for n, sub in inner.items())
    return f"struct<{', '.join(fields)}>"


_NAMES = [
    *P.JSON_TIMESTAMP, *P.JSON_LEVEL, *P.JSON_MESSAGE, *P.JSON_IP, *P.JSON_METHOD,
    *P.JSON_PATH, *P.JSON_STATUS, *P.JSON_SIZE, *P.JSON_USER_AGENT, *P.JSON_RESPONSE_TIME,
]
_FIELDS = _schema(_NAMES)


def known_fields(text: Column, wrapped: Column) -> Column:
    """All fields a log line is probed for, if the line is one JSON object, else NULL.

    ``wrapped`` is :func:`wrapped_json` of the text, as a column of its own. The fields are
    taken out in one walk over the object; asking for them by path would search the object
    once per name.
    """
    shaped = text.startswith("{") & text.endswith("}")
    return F.when(
        shaped & is_single_value(text, wrapped), F.try_variant_get(wrapped, "$[0]", _FIELDS)
    )


class JsonLine:
    """Entry columns of a JSON line, from its :func:`known_fields`.

    A VARIANT is costly to turn into text, so this happens once per field, in columns
    (:meth:`text_columns`) the caller adds before it uses the properties. Those not needed
    are pruned.
    """

    def __init__(self, raw: Column, known: Column):
        self.raw = raw
        self.known = known

    def text_columns(self) -> list[Column]:
        return [
            self._value(name).try_cast("string").alias(self._column(name)) for name in _NAMES
        ]

    @staticmethod
    def _column(name: str) -> str:
        return f"_json_{_NAMES.index(name)}"

    def _value(self, name: str) -> Column:
        return reduce(lambda column, part: column[part], name.split("."), self.known)

    def text(self, name: str) -> Column:
        """Text of a field; JSON text for objects and arrays; NULL if absent or null."""
        return F.col(self._column(name))

    def _is_text(self, name: str) -> Column:
        return F.schema_of_variant(self._value(name)) == "STRING"

    def _is_number(self, name: str) -> Column:
        return self.text(name).rlike(_NUMBER) & ~self._is_text(name)

    def _is_falsy(self, name: str) -> Column:
        """Absent, null, empty, zero or false. The type is asked only in case of doubt:
        the texts "0" and "false" count, the values do not."""
        text = self.text(name)
        return text.isNull() | (text.rlike(_FALSY) & ~((text != "") & self._is_text(name)))

    def first_of(self, names: Sequence[str], value) -> Column:
        """``value(name)`` for the first name whose field is not falsy."""
        chain = F
        for name in names:
            chain = chain.when(~self._is_falsy(name), value(name))
        return chain.otherwise(None)

    def _first_text(self, names: Sequence[str]) -> Column:
        return self.first_of(names, self.text)

    @property
    def ip(self) -> Column:
        return self._first_text(P.JSON_IP)

    @property
    def method(self) -> Column:
        return self._first_text(P.JSON_METHOD)

    @property
    def path(self) -> Column:
        return self._first_text(P.JSON_PATH)

    @property
    def user_agent(self) -> Column:
        return self._first_text(P.JSON_USER_AGENT)

    def _whole(self, name: str) -> Column:
        # Numbers in exponent form are read as numbers, all else by its leading digits.
        number = self.text(name).try_cast("double").try_cast("bigint")
        return F.when(self.text(name).contains("E") & self._is_number(name), number).otherwise(
            int_prefix(self.text(name))
        )

    @property
    def status(self) -> Column:
        return self.first_of(P.JSON_STATUS, self._whole).try_cast("int")

    @property
    def size(self) -> Column:
        return self.first_of(P.JSON_SIZE, self._whole)

    @property
    def response_time(self) -> Column:
        return float_prefix(self._first_text(P.JSON_RESPONSE_TIME))

    @property
    def timestamp(self) -> Column:
        """First candidate that is a time at all.

        Nearly always that is the first one present. Only if it is not, the others are
        tried, in a lambda that keeps eight copies of the same code out of the stage.
        """
        names = P.JSON_TIMESTAMP

        def time(text: Column, is_number: Column) -> Column:
            number = text.try_cast("double")
            return F.when(is_number, epoch_time(number)).otherwise(general_time(text))

        first_text = F.coalesce(*[self.text(name) for name in names])
        first_is_number = F.coalesce(*[self._is_number(name) for name in names])
        candidates = F.array(
            *[F.struct(self.text(n).alias("text"), self._is_number(n).alias("n")) for n in names]
        )
        times = F.transform(candidates, lambda c: time(c["text"], c["n"]))
        return F.coalesce(
            time(first_text, first_is_number),
            F.get(F.filter(times, lambda t: t.isNotNull()), F.lit(0)),
        )

    def _level(self, name: str) -> Column:
        return F.when(self._is_number(name), numeric_level(self.text(name))).otherwise(
            normalize_level(strip(F.lower(self.text(name))))
        )

    @property
    def level(self) -> Column:
        """First usable level; if none is, the last candidate decides unless it is absent."""
        return F.coalesce(
            self.first_of(P.JSON_LEVEL, self._level), self._level(P.JSON_LEVEL[-1]), F.lit("info")
        )

    @property
    def message(self) -> Column:
        """First field present, or the object without its time and level."""
        return F.coalesce(*[self.text(name) for name in P.JSON_MESSAGE], self._rest())

    def _rest(self) -> Column:
        fields = F.from_json(self.raw, "map<string,variant>")
        fields = F.map_filter(fields, lambda k, _: ~k.isin(P.JSON_NOT_IN_MESSAGE))
        keys = F.array_distinct(F.map_keys(fields))
        last = F.map_from_arrays(
            keys,
            F.transform(
                keys,
                lambda key: F.element_at(
                    F.filter(F.map_entries(fields), lambda e: e["key"] == key), -1
                )["value"],
            ),
        )
        repeated = F.size(keys) < F.size(F.map_keys(fields))
        return F.to_json(F.when(repeated, last).otherwise(fields))
