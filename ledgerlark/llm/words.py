"""Word lists of the patent corpus, given to the operators by its queries. They are short and closed: the corpus's own
conventions for entries without a name and for notes around one. Given names and their short forms are learned, not listed."""

from __future__ import annotations

from ledgerlark.llm.labels import LabelWords
from ledgerlark.llm.names import NameWords

# Entries that name nobody, notes around names, titles, words in a group's label.
PATENT_NAMES = NameWords(
    nobody=frozenset(
        "|N/A|NA|TRIBAL|TRIBE|UNKNOWN|NOT KNOWN|NOT STATED|NOT GIVEN|NONE|NONE GIVEN|UNITED STATES|ILLEGIBLE|NAME ILLEGIBLE|NO NAME|UNNAMED|HEIRS|HEIRS NOT KNOWN|HEIRS UNKNOWN|NAMES UNKNOWN|ESTATE|VARIOUS|PUBLIC|?".split("|")
    ),
    notes=r"\b(?:HEIRS?\s+OF|(?:THE\s+)?ESTATE\s+OF|ET\s+AL|ET\s+UX|DECEASED|DEC'?D|MRS|MISS|MR)\b\.?",
    titles=frozenset("MRS MISS MR HEIRS ESTATE NOT UNITED THE JR SR UNKNOWN TRIBAL NONE".split()),
    generic=r"\b(?:TRIBES?|BANDS?|NATION|INDIANS?|PEOPLE|ALLOTTEES?|RESERVATION|IND|TR|OF|AND|THE)\b|\(.*\)",
)
# States as written behind labels, generic words, labels that name nothing, shortened directions, digits typed for letters.
TRIBE_LABELS = LabelWords(
    states={
        "AZ": ["ARIZ", "ARIZONA"], "CA": ["CALIF", "CALIFORNIA"], "CO": ["COLO", "COLORADO"], "ID": ["IDAHO", "IDA"], "IA": ["IOWA"], "KS": ["KANS", "KANSAS"], "MI": ["MICH", "MICHIGAN"], "MN": ["MINN", "MINNESOTA"],
        "MT": ["MONT", "MONTANA"], "NE": ["NEBR", "NEBRASKA", "NEB"], "NV": ["NEV", "NEVADA"], "NM": ["N MEX", "NEW MEXICO"], "ND": ["N DAK", "NORTH DAKOTA"], "OK": ["OKLA", "OKLAHOMA"], "OR": ["OREG", "OREGON", "ORE"],
        "SD": ["S DAK", "SOUTH DAKOTA"], "TX": ["TEX", "TEXAS"], "UT": ["UTAH"], "WA": ["WASH", "WASHINGTON"], "WI": ["WIS", "WISCONSIN", "WISC"], "WY": ["WYO", "WYOMING"],
    },
    generic="MEMBERS? OF|TRIBES? OF INDIANS|INDIAN RESERVATION|RESERVATION|RESERVE|RESERV|RESN|RES|AGENCY|TRIBES? OF|BANDS? OF|NATION OF|TRIBAL|TRIBES?|BANDS?|NATION|PEOPLE|ALLOTTEES?|INDIANS?|IND|TR|THE",
    nothing="UNKNOWN|UNCLEAR|MIXED BLOOD|REMARKS|LEDGER|UNIDENTIFIED|NOT STATED|NOT GIVEN|NONE|NONE GIVEN|NA|N A|FRN|MIXED|ILLEGIBLE|SEE REMARKS|SEE LEDGER|VARIOUS|ACTUAL UNKNOWN|ACTUAL TRIBE UNKNOWN|LANDS|PUBLIC|NO|BLANK|OTHER",
    short=(("UPP|UPR|UP(?=\\\\.)", "UPPER"), ("LOW|LWR|LO(?=\\\\.)", "LOWER"), ("EAST|E(?=\\\\.)", "EASTERN"), ("WEST|W(?=\\\\.)", "WESTERN"), ("NORTH|NO?(?=\\\\.)", "NORTHERN"), ("SOUTH|SO?(?=\\\\.)", "SOUTHERN")),
    letters=("0158", "OISB"),
)
