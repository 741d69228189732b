"""Code to text tables and rule chains for network assets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpulse.functions.cleaning import as_column

# Cause number to cause text, 46 has no entry.
CAUSES = {
    1: "Afectación de usuarios de transformador por desconexión programada de un único usuario",
    2: "Apertura por ejecución de esquemas suplementarios",
    3: "Aperturas programadas en zonas especiales por fuera del periodo de continuidad acordado",
    4: "Incumplimiento en contrato de servicios públicos por parte del usuario",
    5: "Interrupción programada que afecta usuarios de alumbrado público, entre 6 am y 6 pm",
    6: "Interrupción no programada que afecta usuarios de alumbrado público, entre 6 am y 6 pm",
    7: "Limitación del suministro por incumplimiento del comercializador",
    8: "Mantenimiento del transformador de potencia o de sus equipos asociados",
    9: "Mantenimiento preventivo sobre las redes",
    10: "Plan anual de trabajos de reposición o modernización de subestaciones",
    11: "Proyectos de adecuaciones y traslado de infraestructura eléctrica",
    12: "Racionamiento en el SIN",
    13: "Remodelación, reposición o ampliación de redes en el SDL",
    14: "Solicitud de particulares propietarios del activo",
    15: "Acciones de terceros",
    16: "Acercamiento entre redes del SDL",
    17: "Actos de terrorismo",
    18: "Afectación por fallas en redes de otros OR",
    19: "Animales sobre las redes del SDL",
    20: "Apertura en redes del SDL por causa de equipos o líneas del STN o STR",
    21: "Apertura por actuación de esquemas de protección en SDL",
    22: "Apertura por equipo o material con defecto de fabricación",
    23: "Apertura por pérdida de aislamiento",
    24: "Apertura urgente para garantizar la continuidad del servicio",
    25: "Aperturas causadas por autogeneradores",
    26: "Aperturas no programadas en zonas especiales por fuera del periodo de continuidad acordado",
    27: "Árbol o rama sobre redes del SDL",
    28: "Catástrofes naturales",
    29: "Causa desconocida",
    30: "Condiciones atmosféricas",
    31: "Error de operación",
    32: "Falla activo nivel 1 propiedad particular",
    33: "Falla del transformador de potencia o en sus equipos asociados",
    34: "Falla en elementos de protección de la red del SDL",
    35: "Falla en equipos de red",
    36: "Falla en la coordinación de protecciones",
    37: "Falla en postes y/o crucetas en el SDL",
    38: "Falla en redes de baja tensión",
    39: "Falla en redes de distribución y elementos asociados",
    40: "Falla en transformador de distribución o sus elementos asociados",
    41: "Seguridad ciudadana",
    42: "Sobrecarga de la red del SDL",
    43: "Apertura por actuación de esquemas de protección en SDL debida a necesidades en el STN o STR",
    44: "Apertura por actuación de esquemas de protección en SDL debida al mismo sistema",
    45: "Interrupción para enfrentar situaciones de riesgo de la vida humana",
    47: "Evento Omitido",
}

# Phase code to number of phases.
PHASES = {1: 1, 2: 1, 3: 2, 4: 1, 5: 2, 6: 2, 7: 3, 8: 0, 9: 1, 10: 1, 11: 2, 12: 1, 13: 2, 14: 2, 15: 3}

# Pole material.
POLE_MATERIALS = {
    "B": "Tubo metálico",
    "C": "Torrecilla cuadrada",
    "G": "Torre tipo guacaica",
    "H": "Torrecilla metálica triangular",
    "I": "Poste concreto sección I",
    "K": "Torre metálica cuadrada",
    "M": "Poste en madera",
    "P": "Poste metálico",
    "R": "Riel",
    "S": "Torre Auto Soportada",
    "T": "Poste en Concreto",
    "V": "Poste de fibra de vidrio",
    "Z": "Angulo enterrado",
}

# Primary guy letter to number.
GUY_LETTERS = {"A": 10, "B": 11, "C": 12, "D": 13, "E": 14, "F": 15, "G": 16}

# Switch assembly.
SWITCH_ASSEMBLIES = {
    "1CC": "Cortacircuito monofásico",
    "1CFR": "Cortacircuito monofásico con fusible de repetición",
    "1CR": "Cortacircuito monofásico camara romperarco",
    "2CC": "Cortacircuito bifásico - Caja Vela",
    "2CFR": "Cortacircuito bifásico con fusible de repetición",
    "2CR": "Cortacircuito bifásico camara romperarco",
    "3CC": "Cortacircuito trifásico - Caja Vela",
    "3CFR": "Cortacircuito trifásico con fusible de repetición",
    "3CR": "Cortacircuito trifásico con cámara romperarco",
    "3OC": "Seccionador trifásico de operación con carga",
    "3OS": "Seccionador trifásico de operación sin carga o Cuchillas",
    "3RG": "Reconectador trifásico General",
    "3RL": "Reconectador trifásico en la línea",
    "3SC": "Seccionador operación con carga y Cuchillas",
    "ARCOS": "ARCOS",
}

# Switch state; the first text ends in a space.
SWITCH_STATES = {0: "Normalmente abierto ", 3: "Normalmente cerrado", 7: "Normalmente cerrado"}

# Substation kind.
SUBSTATIONS = {
    0: "Subestación de patio híbrida de media y alta tensión",
    1: "Subestación de patio de alta y extra alta tensión",
    2: "Subestación de alta y extra alta tensión tipo interior",
    3: "Subestación de patio de distribución de media tensión",
    4: "Subestaciones en interiores de distribución en media tensión",
    5: "Subestaciones en interiores de edificaciones",
    6: "Subestaciones tipo pedestal",
    7: "Subestaciones sumergibles",
    8: "Subestaciones semisumergibles",
    9: "Subestaciones de distribución tipo poste",
}

# Transformer owner letter.
TRANSFORMER_OWNERS = {"S": "C", "N": "P"}

# Default pole length by assembly, in metres.
POLE_LENGTHS = {"FACHADA": 6.0, "FICTICIO": 10.0, "PORTICO": 10.0}

# Medium voltage levels kept, in kV.
MEDIUM_VOLTAGES = (7.6, 7.62, 7.621, 13.2, 33.0)

# Cause texts that make an event ineligible, and the longest duration kept in hours.
EXCLUDED_CAUSES = (CAUSES[4], CAUSES[32])
LONGEST_HOURS = 120.0


def code_text(value: Column | str, table: Mapping) -> Column:
    """Text of a code; a code without an entry stays as it is."""
    text = as_column(value).cast("string")
    pairs = [F.lit(str(x)) for item in table.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[text], text)


def owner_class(owner: Column | str, company: Sequence[str]) -> Column:
    """``C`` for the names of the ``company``, whatever their case, ``P`` for every other owner, blank included."""
    name = F.lower(F.trim(F.coalesce(as_column(owner), F.lit(""))))
    return F.when(name.isin(*[n.lower() for n in company]), "C").otherwise("P")


def owner_type(declared: Column | str, owner: Column | str, company: Sequence[str]) -> Column:
    """Declared owner type, else the class of the owner."""
    return F.coalesce(F.nullif(F.trim(as_column(declared)), F.lit("")), owner_class(owner, company), F.lit("C"))


def eligible_event(cause_type: Column, element: Column, cause: Column, hours: Column) -> Column:
    """Unplanned events on 13.2/33 kV lines, or any transformer event, minus excluded causes and long ones."""
    kind = ((cause_type == "NP") & element.isin("13.2", "33")) | element.isin("TFD", "TFP")
    # an event without a cause is not equal to an excluded cause, so it stays
    allowed = ~F.coalesce(cause.isin(*EXCLUDED_CAUSES), F.lit(False))
    return F.coalesce(kind, F.lit(False)) & allowed & (hours <= LONGEST_HOURS)


def voltage_kept(value: Column | str, levels=MEDIUM_VOLTAGES, dropped=(115.0,)) -> Column:
    kv = as_column(value).cast("double")
    return kv.isin(*levels) & ~kv.isin(*dropped)


def pole_attributes(
    frame: DataFrame,
    assembly: str = "assembly",
    pole_class: str = "pole_class",
    material: str = "material",
    length: str = "pole_length",
    grounding: str = "grounding",
    primary_guy: str = "primary_guy",
    secondary_guy: str = "secondary_guy",
    owner: str = "owner_type",
) -> DataFrame:
    """Default lengths, material text, guy sum and the fills for first-class poles, in that order."""
    none = F.lit("No aplica")
    raw_material = F.col(material)
    first_class = F.col(pole_class) == "F"
    default_length = F.create_map(*[F.lit(x) for item in POLE_LENGTHS.items() for x in item])[F.col(assembly)]
    metres = F.coalesce(default_length, F.col(length).cast("double"))
    guys = code_text(primary_guy, GUY_LETTERS).try_cast("double") + F.col(secondary_guy).cast("double")
    bare = first_class & raw_material.isNull()
    return frame.withColumns(
        {
            "_guys": F.when(bare, none).otherwise(guys.cast("string")),
            "_ground": F.when(bare, none)
            .when(first_class & F.col(grounding).isNull(), F.lit("0"))
            .otherwise(F.col(grounding).cast("string")),
            "_material": F.when(bare, none).otherwise(code_text(material, POLE_MATERIALS)),
            "_length": F.when(first_class & metres.isNull(), none).otherwise(metres.cast("string")),
            owner: F.coalesce(F.col(owner), F.lit("C")),
        }
    ).drop(material, length, grounding, primary_guy, secondary_guy).withColumnsRenamed(
        {"_guys": "guys", "_ground": grounding, "_material": material, "_length": length}
    )
