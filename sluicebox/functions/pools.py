"""Word pools for synthetic text, one set per locale. Fixed values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Locale:
    first_names: tuple[str, ...]
    last_names: tuple[str, ...]
    last_names_per_person: int
    words: tuple[str, ...]  # 64 of them: one word is six bits of a draw
    street_kinds: tuple[str, ...]
    cities: tuple[str, ...]
    countries: tuple[str, ...]
    company_suffixes: tuple[str, ...]
    email_domains: tuple[str, ...]
    phone_prefix: str
    phone_digits: int


ES_ES = Locale(
    first_names=(
        "Alba", "Alejandro", "Álvaro", "Ana", "Andrés", "Beatriz", "Carlos", "Carmen", "Clara", "Daniel", "David",
        "Elena", "Emilio", "Eva", "Francisco", "Gonzalo", "Inés", "Irene", "Javier", "Jorge", "José", "Laura",
        "Lucía", "Luis", "Manuel", "María", "Marta", "Miguel", "Nuria", "Pablo", "Raúl", "Sofía",
    ),
    last_names=(
        "Aguilar", "Alonso", "Álvarez", "Blanco", "Castro", "Delgado", "Díaz", "Domínguez", "Fernández", "García",
        "Gil", "Gómez", "González", "Gutiérrez", "Hernández", "Iglesias", "Jiménez", "López", "Marín", "Martín",
        "Molina", "Moreno", "Muñoz", "Navarro", "Núñez", "Ortega", "Pérez", "Ramos", "Romero", "Ruiz", "Sánchez",
        "Torres",
    ),
    last_names_per_person=2,
    words=(
        "agua", "aire", "alto", "amigo", "árbol", "arena", "azul", "barco", "bosque", "brisa", "calle", "campo",
        "canto", "casa", "cielo", "ciudad", "claro", "costa", "cuento", "día", "estrella", "flor", "fuego", "fuente",
        "gato", "grano", "hoja", "isla", "jardín", "lago", "libro", "luna", "luz", "madera", "mano", "mar", "mesa",
        "molino", "monte", "noche", "nube", "ola", "oro", "pan", "papel", "piedra", "playa", "plaza", "pluma",
        "puente", "puerta", "río", "roca", "sal", "senda", "sol", "sombra", "tierra", "tinta", "torre", "valle",
        "vela", "viento", "voz",
    ),
    street_kinds=("Calle", "Avenida", "Plaza", "Paseo"),
    cities=(
        "Alicante", "Barcelona", "Bilbao", "Burgos", "Cádiz", "Córdoba", "Gijón", "Granada", "León", "Madrid",
        "Málaga", "Murcia", "Oviedo", "Sevilla", "Valencia", "Zaragoza",
    ),
    countries=(
        "Alemania", "Argentina", "Brasil", "Chile", "Colombia", "España", "Francia", "Grecia", "Italia", "Japón",
        "Marruecos", "México", "Noruega", "Perú", "Portugal", "Suecia",
    ),
    company_suffixes=("S.L.", "S.A.", "S.Coop.", "e Hijos"),
    email_domains=("example.es", "example.com", "example.org", "example.net"),
    phone_prefix="+34 6",
    phone_digits=8,
)

EN_US = Locale(
    first_names=(
        "Alice", "Amy", "Andrew", "Anna", "Brian", "Carol", "Chris", "Daniel", "David", "Diane", "Emily", "Eric",
        "Frank", "Grace", "Helen", "Henry", "Jack", "James", "Jane", "John", "Julia", "Karen", "Kevin", "Laura",
        "Linda", "Mark", "Mary", "Nancy", "Paul", "Peter", "Sarah", "Thomas",
    ),
    last_names=(
        "Adams", "Allen", "Baker", "Brown", "Campbell", "Carter", "Clark", "Cook", "Davis", "Edwards", "Evans",
        "Green", "Hall", "Harris", "Hill", "Jackson", "Johnson", "Jones", "King", "Lee", "Lewis", "Martin", "Miller",
        "Moore", "Nelson", "Parker", "Roberts", "Smith", "Taylor", "Turner", "Walker", "Wilson",
    ),
    last_names_per_person=1,
    words=(
        "apple", "arrow", "autumn", "bird", "boat", "book", "bread", "bridge", "candle", "castle", "cloud", "coast",
        "coin", "corner", "cotton", "dawn", "desk", "door", "dream", "earth", "field", "fire", "flower", "forest",
        "garden", "glass", "gold", "grain", "harbor", "hill", "house", "island", "lake", "lamp", "leaf", "letter",
        "light", "market", "meadow", "mirror", "moon", "morning", "mountain", "night", "ocean", "paper", "path",
        "pencil", "rain", "river", "road", "salt", "shadow", "silver", "song", "star", "stone", "storm", "summer",
        "table", "tower", "valley", "wave", "winter",
    ),
    street_kinds=("Street", "Avenue", "Road", "Lane"),
    cities=(
        "Albany", "Austin", "Boston", "Boulder", "Chicago", "Dallas", "Denver", "Houston", "Madison", "Memphis",
        "Phoenix", "Portland", "Raleigh", "Seattle", "Tampa", "Tucson",
    ),
    countries=(
        "Argentina", "Australia", "Brazil", "Canada", "Chile", "France", "Germany", "Greece", "India", "Ireland",
        "Italy", "Japan", "Mexico", "Norway", "Spain", "Sweden",
    ),
    company_suffixes=("Inc.", "LLC", "Ltd.", "Group"),
    email_domains=("example.com", "example.org", "example.net", "example.edu"),
    phone_prefix="+1 555",
    phone_digits=7,
)

LOCALES = {"es_ES": ES_ES, "en_US": EN_US}

CURRENCY_CODES = ("AUD", "BRL", "CAD", "CHF", "CNY", "EUR", "GBP", "INR", "JPY", "MXN", "NOK", "SEK", "USD", "ZAR")
RANDOM_ELEMENTS = ("a", "b", "c")
CATEGORIES = ("A", "B", "C", "D")

# Letters folded for e-mail addresses, position by position.
ACCENTED = "áéíóúüñ"
FOLDED = "aeiouun"
