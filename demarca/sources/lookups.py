"""Fixed lookup tables, small enough to broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# States.
STATES = {
    "01": "Aguascalientes",
    "02": "Baja California",
    "03": "Baja California Sur",
    "04": "Campeche",
    "05": "Coahuila",
    "06": "Colima",
    "07": "Chiapas",
    "08": "Chihuahua",
    "09": "Ciudad de México",
    "10": "Durango",
    "11": "Guanajuato",
    "12": "Guerrero",
    "13": "Hidalgo",
    "14": "Jalisco",
    "15": "Estado de México",
    "16": "Michoacán",
    "17": "Morelos",
    "18": "Nayarit",
    "19": "Nuevo León",
    "20": "Oaxaca",
    "21": "Puebla",
    "22": "Querétaro",
    "23": "Quintana Roo",
    "24": "San Luis Potosí",
    "25": "Sinaloa",
    "26": "Sonora",
    "27": "Tabasco",
    "28": "Tamaulipas",
    "29": "Tlaxcala",
    "30": "Veracruz",
    "31": "Yucatán",
    "32": "Zacatecas",
}

# Two-digit activity sectors.
SECTORS = {
    "11": "Agricultura, cría y explotación de animales, aprovechamiento forestal, pesca y caza",
    "21": "Minería",
    "22": "Generación, transmisión, distribución y comercialización de energía eléctrica, suministro de agua y de gas "
    "natural por ductos al consumidor final",
    "23": "Construcción",
    "31": "Industrias manufactureras (alimentos, bebidas, tabaco, textiles, prendas de vestir, cuero)",
    "32": "Industrias manufactureras (madera, papel, impresión, petróleo, química, plástico, hule, minerales no "
    "metálicos)",
    "33": "Industrias manufactureras (metálicas básicas, productos metálicos, maquinaria, equipo de cómputo, eléctrico, "
    "transporte, muebles, otras)",
    "43": "Comercio al por mayor",
    "46": "Comercio al por menor",
    "48": "Transportes, correos y almacenamiento (transportes)",
    "49": "Transportes, correos y almacenamiento (correos y almacenamiento)",
    "51": "Información en medios masivos",
    "52": "Servicios financieros y de seguros",
    "53": "Servicios inmobiliarios y de alquiler de bienes muebles e intangibles",
    "54": "Servicios profesionales, científicos y técnicos",
    "55": "Corporativos",
    "56": "Servicios de apoyo a los negocios y manejo de residuos y desechos, y servicios de remediación",
    "61": "Servicios educativos",
    "62": "Servicios de salud y de asistencia social",
    "71": "Servicios de esparcimiento culturales y deportivos, y otros servicios recreativos",
    "72": "Servicios de alojamiento temporal y de preparación de alimentos y bebidas",
    "81": "Otros servicios excepto actividades gubernamentales",
    "93": "Actividades legislativas, gubernamentales, de impartición de justicia y de organismos internacionales y "
    "extraterritoriales",
}

# Authoritative establishment totals per state.
OFFICIAL_TOTALS = {
    "01": 71270,
    "02": 138605,
    "03": 41862,
    "04": 47408,
    "05": 126048,
    "06": 41756,
    "07": 249308,
    "08": 141420,
    "09": 460762,
    "10": 74728,
    "11": 294350,
    "12": 185017,
    "13": 159576,
    "14": 399103,
    "15": 816716,
    "16": 285392,
    "17": 112497,
    "18": 73032,
    "19": 207782,
    "20": 279836,
    "21": 408084,
    "22": 107843,
    "23": 68846,
    "24": 126958,
    "25": 136551,
    "26": 127297,
    "27": 94456,
    "28": 148560,
    "29": 98711,
    "30": 354715,
    "31": 144576,
    "32": 74616,
}

# Housing-finance bodies.
BODIES = {
    1: "INFONAVIT",
    2: "CNBV (banca múltiple)",
    3: "FOVISSSTE",
    4: "SHF",
    5: "CONAVI",
    6: "INVI Ciudad de México",
    7: "Banjercito",
    8: "Hábitat México",
    9: "CFE",
    10: "ISSFAM",
    11: "PEMEX",
    12: "FONHAPO",
    13: "PDZP SEDESOL",
    14: "SOFOLES AMFE",
    15: "ISSSTELEON Nuevo León",
    16: "INDIVI Baja California",
    17: "COVEG Guanajuato",
    18: "COESVI Durango",
    19: "IMEVIS Estado de México",
    20: "IVEM Michoacán",
    21: "ITAVU Tamaulipas",
    22: "IVNL Nuevo León",
    23: "INVIVIENDA Veracruz",
    24: "IVEY Yucatán",
    25: "INFOVIR",
    26: "Instituto Nacional del Suelo Sustentable",
}

# Banks, keyed by text codes with a leading zero.
BANKS = {
    "040002": "BANAMEX",
    "040012": "BBVA México",
    "040014": "SANTANDER",
    "040021": "HSBC México",
    "040030": "BANBAJÍO",
    "040036": "INBURSA",
    "040042": "MIFEL",
    "040044": "SCOTIABANK",
    "040058": "BANREGIO",
    "040059": "INVEX",
    "040062": "AFIRME",
    "040072": "BANORTE",
    "040113": "VE POR MÁS",
    "040127": "AZTECA",
    "040128": "AUTOFIN",
    "040132": "MULTIVA",
    "040137": "BANCOPPEL",
    "040143": "CONSUBANCO",
}

# Modalities, destinations and dwelling tiers.
MODALITIES = {1: "Vivienda nueva", 2: "Mejoramientos", 3: "Vivienda usada", 4: "Otros programas"}
DESTINATIONS = {
    1: "Mejoramientos",
    2: "Vivienda nueva",
    3: "Vivienda usada",
    4: "Pago de pasivos",
    5: "Con disponibilidad de terreno",
    6: "Liquidez",
    7: "Adquisición de suelo",
    8: "Reconstrucción",
    9: "Ampliación",
    10: "Autoproducción",
    11: "Arrendamiento",
    12: "Insumos para vivienda",
    13: "Urbanización para uso habitacional",
    14: "Lotes con servicios",
    15: "Garantías",
    16: "Programas institucionales",
    17: "Contragarantías",
    18: "Regularización de asentamientos",
}
TIERS = {1: "Económica", 2: "Popular", 3: "Tradicional", 4: "Media", 5: "Residencial", 6: "Residencial plus"}

# Airports and their municipalities.
AIRPORTS = {
    "ACAPULCO": "12001",
    "AGUASCALIENTES": "01001",
    "BAJIO": "11020",
    "CAMPECHE": "04002",
    "CANCUN": "23005",
    "CD. DEL CARMEN": "04003",
    "CD. JUAREZ": "08037",
    "CD. OBREGÓN": "26018",
    "CD. VICTORIA": "28041",
    "CHETUMAL": "23004",
    "CHICHÉN ITZÁ": "31091",
    "CIUDAD DE MÉXICO/MEXICO CITY": "09017",
    "COLIMA": "06002",
    "COZUMEL": "23001",
    "CREEL": "08009",
    "CUERNAVACA": "17007",
    "CULIACAN": "25006",
    "DEL NORTE": "19039",
    "DURANGO": "10005",
    "GUADALAJARA": "14039",
    "GUAYMAS": "26029",
    "HERMOSILLO": "26030",
    "HUATULCO": "20413",
    "IXTEPEC": "20014",
    "LA PAZ": "03003",
    "LORETO": "03009",
    "LOS MOCHIS": "25001",
    "MANZANILLO": "06007",
    "MATAMOROS": "28022",
    "MAZATLAN": "25012",
    "MERIDA": "31050",
    "MEXICALI": "02002",
    "MINATITLAN": "30108",
    "MONTERREY": "19039",
    "MORELIA": "16053",
    "NOGALES": "26043",
    "NUEVO LAREDO": "28027",
    "OAXACA": "20067",
    "PALENQUE": "07065",
    "POZA RICA": "30131",
    "PUEBLA": "21114",
    "PUERTO ESCONDIDO": "20318",
    "PUERTO PEÑASCO": "26048",
    "PUERTO VALLARTA": "14067",
    "QUERÉTARO": "22011",
    "REYNOSA": "28032",
    "SAN CRISTOBAL DE LAS CASAS": "07078",
    "SAN JOSE DEL CABO": "03008",
    "SAN LUIS POTOSI": "24028",
    "SANTA LUCÍA": "15120",
    "TAMPICO": "28038",
    "TAMUÍN": "24040",
    "TAPACHULA": "07089",
    "TEHUACÁN": "21156",
    "TEPIC": "18017",
    "TIJUANA": "02004",
    "TORREON": "05035",
    "TULÚM": "23009",
    "TUXTLA GUTIERREZ (ANGEL ALBINO CORZO)": "07101",
    "URUAPAN": "16102",
    "VERACRUZ": "30193",
    "VILLAHERMOSA": "27004",
    "ZACATECAS": "32056",
    "ZIHUATANEJO": "12038",
}

_TABLES: dict[str, tuple[dict, tuple[str, str]]] = {
    "states": (STATES, ("code", "nombre")),
    "sectors": (SECTORS, ("code", "nombre")),
    "official_totals": (OFFICIAL_TOTALS, ("code", "official_total")),
    "bodies": (BODIES, ("code", "nombre")),
    "banks": (BANKS, ("code", "nombre")),
    "modalities": (MODALITIES, ("code", "nombre")),
    "destinations": (DESTINATIONS, ("code", "nombre")),
    "tiers": (TIERS, ("code", "nombre")),
    "airports": (AIRPORTS, ("airport_name", "cve_mun")),
}


def lookup(spark: SparkSession, name: str) -> DataFrame:
    """One fixed lookup as a two-column DataFrame, held in the plan itself."""
    values, columns = _TABLES[name]

    def literal(v: str | int) -> str:
        return str(v) if isinstance(v, int) else "'" + v.replace("'", "\\'") + "'"

    rows = ", ".join(f"({literal(k)}, {literal(v)})" for k, v in values.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({', '.join(columns)})")
