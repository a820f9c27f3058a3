"""Fixed tables and conversions about notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DRUM_CHANNEL = 9

# The 128 General MIDI programs, in program order.
PROGRAMS = (
    "Acoustic Grand Piano", "Bright Acoustic Piano", "Electric Grand Piano", "Honky-tonk Piano",
    "Electric Piano 1", "Electric Piano 2", "Harpsichord", "Clavinet", "Celesta", "Glockenspiel", "Music Box",
    "Vibraphone", "Marimba", "Xylophone", "Tubular Bells", "Dulcimer", "Drawbar Organ", "Percussive Organ",
    "Rock Organ", "Church Organ", "Reed Organ", "Accordion", "Harmonica", "Tango Accordion", "Nylon Guitar",
    "Steel Guitar", "Jazz Guitar", "Clean Guitar", "Muted Guitar", "Overdriven Guitar", "Distortion Guitar",
    "Guitar Harmonics", "Acoustic Bass", "Fingered Bass", "Picked Bass", "Fretless Bass", "Slap Bass 1",
    "Slap Bass 2", "Synth Bass 1", "Synth Bass 2", "Violin", "Viola", "Cello", "Contrabass", "Tremolo Strings",
    "Pizzicato Strings", "Orchestral Harp", "Timpani", "String Ensemble 1", "String Ensemble 2",
    "Synth Strings 1", "Synth Strings 2", "Choir Aahs", "Voice Oohs", "Synth Voice", "Orchestra Hit",
    "Trumpet", "Trombone", "Tuba", "Muted Trumpet", "French Horn", "Brass Section", "Synth Brass 1",
    "Synth Brass 2", "Soprano Sax", "Alto Sax", "Tenor Sax", "Baritone Sax", "Oboe", "English Horn", "Bassoon",
    "Clarinet", "Piccolo", "Flute", "Recorder", "Pan Flute", "Blown Bottle", "Shakuhachi", "Whistle",
    "Ocarina", "Square Lead", "Saw Lead", "Calliope Lead", "Chiff Lead", "Charang Lead", "Voice Lead",
    "Fifths Lead", "Bass + Lead", "New Age Pad", "Warm Pad", "Polysynth Pad", "Choir Pad", "Bowed Pad",
    "Metallic Pad", "Halo Pad", "Sweep Pad", "Rain FX", "Soundtrack FX", "Crystal FX", "Atmosphere FX",
    "Brightness FX", "Goblins FX", "Echoes FX", "Sci-fi FX", "Sitar", "Banjo", "Shamisen", "Koto", "Kalimba",
    "Bagpipe", "Fiddle", "Shanai", "Tinkle Bell", "Agogo", "Steel Drums", "Woodblock", "Taiko Drum",
    "Melodic Tom", "Synth Drum", "Reverse Cymbal", "Guitar Fret Noise", "Breath Noise", "Seashore",
    "Bird Tweet", "Telephone Ring", "Helicopter", "Applause", "Gunshot",
)

# The family of each run of eight programs.
FAMILIES = (
    "piano", "chromatic percussion", "organ", "guitar", "bass", "strings", "ensemble", "brass", "reed", "pipe",
    "synth lead", "synth pad", "synth effects", "ethnic", "percussive", "sound effects",
)

# Drum keys of each group; every other key is "perc".
DRUM_KEYS = {
    "kick": (35, 36),
    "snare": (31, 37, 38, 39, 40),
    "hats": (42, 44, 46, 54, 69, 70, 82),
    "toms": (41, 43, 45, 47, 48, 50, 60, 61, 62, 63, 64, 65, 66, 67, 68),
    "cymbals": (49, 51, 52, 53, 55, 57, 59),
}

# Weight of each scale degree in a major and in a minor key.
MAJOR_PROFILE = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR_PROFILE = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)
PITCH_CLASSES = ("C", "C#", "D", "Eb", "E", "F", "F#", "G", "Ab", "A", "Bb", "B")
NOTE_NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


def program_dim(spark: SparkSession) -> DataFrame:
    """(program, program_name, family)."""
    rows = [(i, n, FAMILIES[i // 8]) for i, n in enumerate(PROGRAMS)]
    return spark.createDataFrame(rows, "program bigint, program_name string, family string")


def drum_group(key: Column) -> Column:
    group = F.lit("perc")
    for name, keys in DRUM_KEYS.items():
        group = F.when(key.isin(*keys), F.lit(name)).otherwise(group)
    return group


def midi_to_hz(midi: Column) -> Column:
    return F.lit(440.0) * F.pow(F.lit(2.0), (midi - 69) / 12.0)


def hz_to_midi(hz: Column) -> Column:
    """Null where there is no pitch."""
    return F.when(hz > 0, F.lit(69.0) + F.lit(12.0) * F.log2(hz / 440.0))


def note_name(midi: Column) -> Column:
    m = F.bround(midi.cast("double")).cast("int")
    names = F.array(*[F.lit(p) for p in NOTE_NAMES])
    return F.concat(F.element_at(names, F.pmod(m, F.lit(12)) + 1),
                    (F.floor(m / 12) - 1).cast("string"))
