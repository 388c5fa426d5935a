"""The column dictionary: what a column is called, its unit, and what its codes mean.

A deployment loads the full dictionary of its publisher as a table with these columns
(:func:`dictionary_rows` shows the shape); the entries here cover the columns the built-in
rules and templates mention.
"""

# --- Fixed values ---------------------------------------------------------------------------
COLUMN_LABELS = {
    "RWY_LEN": "length", "RWY_WIDTH": "width", "SURFACE_TYPE_CODE": "surface", "COND": "pavement condition",
    "RWY_MARKING_COND": "marking condition", "TPA": "traffic pattern altitude", "FUEL_TYPES": "fuel",
    "OTHER_SERVICES": "services", "ARPT_ELEV": "airport elevation", "TDZ_ELEV": "touchdown zone elevation",
    "RWY_END_ELEV": "runway end elevation", "DISPLACED_THR_LEN": "displaced threshold",
    "THR_CROSSING_HGT": "threshold crossing height", "APCH_BEAR": "approach bearing", "G_S_ANGLE": "glideslope angle",
    "CHANNEL": "DME channel", "ASOS_AWOS_TYPE": "weather station type", "SECTORIZATION": "sector",
    "SERVICED_FACILITY": "served facility", "SERVICED_SITE_TYPE": "served facility type", "ADDRESS1": "address",
    "BCN_LENS_COLOR": "beacon", "BCN_LGT_SKED": "beacon schedule", "LGT_SKED": "airport lighting schedule",
    "FACILITY_TYPE": "facility type", "ATIS_HRS": "ATIS hours", "RADAR_HRS": "radar hours", "MAG_VARN": "magnetic variation",
    "MAG_VARN_HEMIS": "magnetic variation direction", "ILS_BASE.COMPONENT_STATUS": "localizer status",
    "ILS_GS.COMPONENT_STATUS": "glideslope status", "ILS_DME.COMPONENT_STATUS": "DME status",
    "ILS_MKR.COMPONENT_STATUS": "marker status", "APT_BASE.NOTAM_ID": "NOTAM facility",
}
COLUMN_UNITS = {
    "RWY_LEN": "ft", "RWY_WIDTH": "ft", "TPA": "ft AGL", "ARPT_ELEV": "ft MSL", "TDZ_ELEV": "ft MSL", "RWY_END_ELEV": "ft MSL",
    "DISPLACED_THR_LEN": "ft", "THR_CROSSING_HGT": "ft AGL", "APCH_BEAR": "° magnetic", "MAG_VARN": "°", "G_S_ANGLE": "°",
}
CODE_MEANINGS = {
    "SURFACE_TYPE_CODE=CONC": "portland cement concrete", "SURFACE_TYPE_CODE=ASPH": "asphalt or bituminous concrete",
    "SURFACE_TYPE_CODE=TURF": "grass; sod", "SURFACE_TYPE_CODE=DIRT": "natural soil",
    "FACILITY_TYPE=ATCT": "air traffic control tower", "FACILITY_TYPE=NON-ATCT": "no air traffic control tower",
    "FACILITY_TYPE=TRACON": "consolidated TRACON", "FACILITY_TYPE=ARTCC": "air route traffic control center",
    "OTHER_SERVICES=AFRT": "air freight services", "OTHER_SERVICES=AGRI": "crop dusting services",
    "OTHER_SERVICES=AMB": "air ambulance services", "OTHER_SERVICES=AVNCS": "avionics",
    "OTHER_SERVICES=CARGO": "cargo handling services", "OTHER_SERVICES=CHTR": "charter service",
    "OTHER_SERVICES=GLD": "glider service", "OTHER_SERVICES=INSTR": "pilot instruction",
    "OTHER_SERVICES=PAJA": "parachute jump activity", "OTHER_SERVICES=RNTL": "aircraft rental",
    "OTHER_SERVICES=SALES": "aircraft sales", "OTHER_SERVICES=SURV": "annual surveying",
    "OTHER_SERVICES=TOW": "glider towing services",
}
LIST_COLUMNS = ("FUEL_TYPES", "OTHER_SERVICES")
NAV_NAMES = {
    "VOT": "VOR test signal (VOT)", "VORTAC": "VORTAC", "VOR/DME": "VOR/DME", "DME": "DME", "NDB": "NDB",
    "VOR": "VOR", "TACAN": "TACAN",
}
ILS_TYPES = {
    "LS": "ILS", "SF": "SDF", "LC": "LOC", "LA": "LDA", "LD": "ILS/DME", "SD": "SDF/DME", "LE": "LOC/DME",
    "LG": "LOC/GS", "DD": "LDA/DME",
}
ILS_REMARK_TYPES = {"LD": "ILS/DME", "LS": "ILS", "LC": "localizer", "LA": "LDA", "SF": "SDF"}
MARKER_TYPES = {"IM": "inner marker", "MM": "middle marker", "OM": "outer marker"}
USE_ROLES = {
    "APCH": "approach", "DEP": "departure", "LCL": "tower (local control)", "GND": "ground control", "CD": "clearance delivery",
}
USE_WORDS = {
    "EMERG": "emergency", "OPS": "operations", "PMSV": "pilot-to-metro service", "D-ATIS": "digital ATIS",
    "GCO": "ground communication outlet (GCO)",
}
PROVIDER_TYPES = {"A": "airport with ATCT", "C": "ARTCC", "S": "special", "T": "TRACON"}
REMARK_LABELS = {
    "NAV_RMK": "navaid remark", "AWOS_RMK": "AWOS remark", "FRQ_RMK": "frequency remark", "ATC_RMK": "tower/ATC remark",
    "CLS_ARSP_RMK": "airspace remark",
}
OBSTACLE_COLUMNS = ("OBSTN_TYPE", "OBSTN_HGT", "DIST_FROM_THR", "CNTRLN_OFFSET", "CNTRLN_DIR_CODE", "OBSTN_CLNC_SLOPE")
SIDE_WORDS = {"L": "left of", "R": "right of", "B": "either side of"}
ROUTE_LABELS = {"Hours1": "hours"}
ROUTE_TELL_APART = ("Type", "Area", "Altitude", "Aircraft", "Direction", "Hours1")
PROCEDURE_USE = r"^(\S+(?: RNAV)?) (STAR|DP)$"
# --------------------------------------------------------------------------------------------


def dictionary_rows() -> list[tuple]:
    """(file, column, code, label, unit, kind) rows of the built-in entries."""
    rows = []
    for name, label in COLUMN_LABELS.items():
        file, _, column = name.rpartition(".")
        rows.append((file, column, "", label, COLUMN_UNITS.get(column, ""), "list" if column in LIST_COLUMNS else "column"))
    for name, meaning in CODE_MEANINGS.items():
        column, _, code = name.partition("=")
        rows.append(("", column, code, meaning, "", "code"))
    return rows


DICTIONARY_SCHEMA = "file string, column string, code string, label string, unit string, kind string"
