"""Column expressions of pitch, notes, names and text. Rounding is half-even (rint), modulo and division floor."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Note labels of the twelve steps above the tonic, and note names.
LABELS = ["Sa", "re", "Re", "ga", "Ga", "ma", "Ma", "Pa", "dha", "Dha", "ni", "Ni"]
NOTE_NAMES = {"C": 0, "C#": 1, "Db": 1, "D": 2, "D#": 3, "Eb": 3, "E": 4, "F": 5, "F#": 6, "Gb": 6, "G": 7, "G#": 8, "Ab": 8, "A": 9, "A#": 10, "Bb": 10, "B": 11}

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hz_to_midi(hz: ColumnOrName) -> Column:
    """Null where the frequency is not finite and positive."""
    hz = col(hz)
    return F.when((hz > 0) & (hz < float("inf")), 69 + 12 * F.log2(hz / 440))


def midi_to_hz(midi: ColumnOrName) -> Column:
    return 440 * F.pow(F.lit(2.0), (col(midi) - 69) / 12)


def half_even(x: ColumnOrName) -> Column:
    return F.rint(x)


def floor_mod(x: ColumnOrName, n: int) -> Column:
    return F.pmod(col(x), F.lit(n))


def pitch_class(midi: ColumnOrName) -> Column:
    return floor_mod(half_even(midi), 12).cast("int")


def cents(midi: ColumnOrName) -> Column:
    """Position in the octave, 0 to 1200."""
    return F.pmod(col(midi), F.lit(12.0)) * 100


def circular_distance(a: ColumnOrName, b: ColumnOrName, whole: float = 1200.0) -> Column:
    return F.abs(F.pmod(col(a) - col(b) + whole / 2, F.lit(whole)) - whole / 2)


def label_of(step: Column) -> Column:
    """Null for a null step: ``element_at`` takes its result for never null here, and makes a label of whatever is left there."""
    return F.get(F.array(*[F.lit(x) for x in LABELS]), step.cast("int"))


def octave_marks(octave: Column) -> Column:
    """An apostrophe for each octave below, a raised dot for each above."""
    below, above = F.repeat(F.lit("'"), -octave), F.repeat(F.lit("·"), octave)
    return F.when(octave < 0, below).when(octave > 0, above).otherwise("")


def label(midi: ColumnOrName, tonic: ColumnOrName) -> Column:
    """Step above a tonic given as a pitch class, with marks for the octaves from the tonic at 48 to 59 upwards."""
    octave = F.floor((col(midi) - (col(tonic) + 48)) / 12).cast("int")
    return F.concat(label_of(floor_mod(half_even(col(midi) - col(tonic)), 12)), octave_marks(octave))


def event_label(midi: ColumnOrName, tonic: ColumnOrName) -> Column:
    """Step above a tonic given as a pitch, perhaps between two notes, with marks for the octaves nearest to it."""
    away = col(midi) - col(tonic)
    return F.concat(label_of(floor_mod(half_even(away), 12)), octave_marks(half_even(away / 12).cast("int")))


def lm_token(midi: ColumnOrName, tonic: ColumnOrName) -> Column:
    """Step and octave mark, at most one octave either way: ' below, '' above."""
    away = half_even(col(midi)) - half_even(col(tonic))
    octave = F.floor(away / 12)
    return F.concat(label_of(floor_mod(away, 12)), F.when(octave <= -1, "'").when(octave >= 1, "''").otherwise(""))


def motif_token(label: ColumnOrName, pc: ColumnOrName, tonic: ColumnOrName) -> Column:
    return F.concat_ws(":", plain_label(label), floor_mod(col(pc) - col(tonic), 12).cast("string"))


def plain_label(label: ColumnOrName) -> Column:
    """Without typographic marks; the plain apostrophe stays."""
    return F.translate(F.trim(F.coalesce(col(label), F.lit(""))), "’`·", "")


def bare_label(label: ColumnOrName) -> Column:
    return F.translate(col(label), "'·", "")


def label_step(label: ColumnOrName) -> Column:
    """Step of a label by its lower-case form, the first of those alike: Re is found as re."""
    out = F.lit(None).cast("int")
    for i, x in reversed(list(enumerate(LABELS))):
        out = F.when(F.lower(bare_label(label)) == x.lower(), i).otherwise(out)
    return out


def note_step(name: ColumnOrName) -> Column:
    """Pitch class of a note name, case kept; null if unknown."""
    known = F.create_map(*[F.lit(x) for kv in NOTE_NAMES.items() for x in kv])
    return F.try_element_at(known, col(name))


def note_midi(name: ColumnOrName, unknown: float = 60.0) -> Column:
    """A note name without an octave in the octave of 60; ``unknown`` for what is none."""
    return F.coalesce(60.0 + note_step(F.trim(col(name))), F.lit(unknown))


def resolve_tonic(text: ColumnOrName) -> Column:
    """A tonic as a pitch: a number over 200 with a fraction part is a frequency, other numbers are pitches; a note name with an
    octave is that note, one without stands in the octave of 60; 60 for all else."""
    x = F.trim(col(text))
    number = x.try_cast("double")
    parts = F.regexp_extract(x, r"^([A-G][#b]?)(-?\d+)?$", 1)
    octave = F.regexp_extract(x, r"^([A-G][#b]?)(-?\d+)?$", 2).try_cast("int")
    step = note_step(parts)
    named = F.when(octave.isNull(), 60.0 + step).otherwise((octave + 1) * 12.0 + step)
    frequency = x.contains(".") & (number > 200)
    return F.coalesce(F.when(frequency, hz_to_midi(number)).otherwise(number), named, F.lit(60.0))


def label_midi(label: ColumnOrName, tonic: ColumnOrName, octave: int = 4) -> Column:
    """The pitch of a label with octave marks above a tonic given as a pitch class; null for an unknown label."""
    marks = lambda x: F.length(col(label)) - F.length(F.replace(col(label), F.lit(x), F.lit("")))
    return col(tonic) + label_step(label) + 12 * (octave + marks("·") - marks("'"))


def snap_in_scale(midi: ColumnOrName, tonic: ColumnOrName, allowed: list[int], most: float = 1.0) -> Column:
    """The nearest pitch of a scale on the tonic, from the octaves around; of two as near, the higher. Null if none is within
    ``most``."""
    midi, tonic = col(midi), col(tonic)
    octave = F.floor(half_even(midi - tonic) / 12)
    steps = [tonic + (octave + o) * 12 + s for o in (-1, 0, 1) for s in sorted({x % 12 for x in allowed})]
    best = F.array_min(F.array(*[F.struct(F.round(F.abs(x - midi), 9).alias("away"), (-x).alias("x")) for x in steps]))
    return F.when(best["away"] <= most, -best["x"])


def same_name(aliases: ColumnOrName, name: ColumnOrName, squeeze: bool = False) -> Column:
    """Whether one of a comma list of names equals a name but for case and outer spaces; with ``squeeze`` for all spaces."""
    plain = lambda x: F.replace(F.lower(F.trim(x)), F.lit(" "), F.lit("")) if squeeze else F.lower(F.trim(x))
    return F.exists(F.split(col(aliases), ","), lambda x: plain(x) == plain(col(name)))


def predicted_name(aliases: ColumnOrName, name: ColumnOrName) -> Column:
    """The true name where the aliases hold it, else the first alias."""
    return F.when(same_name(aliases, name), col(name)).otherwise(F.trim(F.get(F.split(col(aliases), ","), F.lit(0))))


def normal_name(name: ColumnOrName) -> Column:
    """Lower case, without parts in brackets; other than a-z, 0-9 become single spaces."""
    x = F.regexp_replace(F.lower(F.coalesce(col(name), F.lit(""))), r"\(.*?\)", "")
    return F.trim(F.regexp_replace(F.regexp_replace(x, "[^a-z0-9 ]", " "), " +", " "))


def clock_seconds(text: ColumnOrName) -> Column:
    """SS, MM:SS or HH:MM:SS; null if it is neither or negative."""
    parts = F.transform(F.split(F.trim(col(text)), ":"), lambda x: x.try_cast("double"))
    fine = (F.size(parts) <= 3) & F.forall(parts, lambda x: x.isNotNull() & (x >= 0))
    return F.when(fine, F.aggregate(parts, F.lit(0.0), lambda s, x: s * 60 + x))


def safe_name(name: ColumnOrName) -> Column:
    return F.regexp_replace(F.regexp_replace(col(name), "[^A-Za-z0-9._-]+", "_"), "^[._-]+|[._-]+$", "")


def stem(path: ColumnOrName) -> Column:
    """Last part of a path without its last suffix, lower case."""
    return F.lower(F.regexp_replace(F.regexp_extract(col(path), "([^/]*)$", 1), r"(.)\.[^.]*$", "$1"))


def name_list(raw: ColumnOrName) -> Column:
    """A comma list, perhaps in brackets and quotes; null is one unknown name."""
    x = F.translate(col(raw), "[]'\"", "")
    return F.when(col(raw).isNull(), F.array(F.lit("Unknown"))).otherwise(F.filter(F.transform(F.split(x, ","), lambda y: F.trim(y)), lambda y: y != ""))


def truth(x: ColumnOrName) -> Column:
    return F.lower(F.trim(col(x).cast("string"))).isin("1", "1.0", "true", "t", "yes", "y")


def finite(x: ColumnOrName) -> Column:
    """Null where a number is not finite."""
    return F.when(~F.isnan(col(x)) & (F.abs(col(x)) < float("inf")), col(x))


def url_token(x: ColumnOrName) -> Column:
    return F.regexp_replace(F.translate(F.base64(col(x).cast("binary")), "+/", "-_"), "=+$", "")


def snap(midi: ColumnOrName) -> Column:
    """The nearer of floor and ceiling; a tie goes down."""
    midi = col(midi)
    return F.when(midi - F.floor(midi) <= F.ceil(midi) - midi, F.floor(midi)).otherwise(F.ceil(midi)).cast("double")


def near(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Names are alike if equal or one holds the other."""
    a, b = F.lower(F.trim(col(a))), F.lower(F.trim(col(b)))
    return (a == b) | a.contains(b) | b.contains(a)
