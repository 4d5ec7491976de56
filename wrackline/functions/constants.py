"""The scene classification, and the texts that metric results carry."""

#: Class, label, hex colour, red, green, blue.
SCL_LEGEND = [
    (0, "Sin datos", "#000000", 0, 0, 0),
    (1, "Saturado/Defectuoso", "#ff0000", 255, 0, 0),
    (2, "Sombra oscura", "#2f2f2f", 47, 47, 47),
    (3, "Sombra nube", "#643200", 100, 50, 0),
    (4, "Vegetación", "#00a000", 0, 160, 0),
    (5, "No vegetación", "#ffe65a", 255, 230, 90),
    (6, "Agua", "#0000ff", 0, 0, 255),
    (7, "Incierto", "#808080", 128, 128, 128),
    (8, "Nube media", "#c0c0c0", 192, 192, 192),
    (9, "Nube alta", "#ffffff", 255, 255, 255),
    (10, "Cirrus", "#64c8ff", 100, 200, 255),
    (11, "Nieve/Hielo", "#ff96ff", 255, 150, 255),
]
BAD, UNCERTAIN = (3, 8, 9, 10, 11), (3, 8, 9, 10)
WATER, LAND, CLEAR = 6, (4, 5), (4, 5, 6)
TRANSITION, STABLE_WATER, STABLE_LAND = 0, 1, 2

#: Fixed texts and bounds of the results (lower bounds of the p-value, upper bounds of the ratio and of the resolution).
KS_TEXTS = [(0.1, "Altamente uniforme"), (0.05, "Razonablemente uniforme"), (0.01, "Moderadamente no uniforme"), (None, "Altamente no uniforme")]
VMR_TEXTS = [(0.8, "Regular (uniforme)"), (1.2, "Aleatorio (Poisson)"), (None, "Agrupado (clustered)")]
VSR_TEXTS = [
    (0.1, "Alta (excelente para topografía detallada)"),
    (0.2, "Buena (adecuada para la mayoría de análisis)"),
    (0.3, "Moderada (puede perder algunos detalles)"),
    (None, "Baja (resolución insuficiente para detalles finos)"),
]
UNDEFINED = "Indefinido"
GRADES = [(0.85, "Excelente"), (0.65, "Buena"), (0.50, "Aceptable"), (None, "Pobre")]
ADVICE_COVERAGE = ("Cobertura insuficiente (", "%). Añadir imágenes en mareas extremas.")
ADVICE_VSR = ("VSR demasiado alta (", " m). Aumentar el número de observaciones.")
ADVICE_REPRESENTATIVE = ("Baja representatividad (", "%). Añadir imágenes en quantiles ", ".")
ADVICE_UNIFORM = "Distribución no uniforme. Seleccionar imágenes más distribuidas en el rango mareal."
ADVICE_GROUPED = ("Muestras agrupadas (VMR=", "). Distribuir observaciones más uniformemente.")
