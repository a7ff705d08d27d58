"""Words that mark a contact page."""

from __future__ import annotations

# A page counts as a contact page when its path holds one of these.
CONTACT_WORDS = (
    # Spanish
    "contact", "contacto", "about", "info", "acerca", "informacion", "información",
    "equipo", "team", "nosotros", "empresa", "quienes-somos",
    # English
    "contact-us", "about-us", "support", "help", "reach", "get-in-touch",
    "who-we-are", "our-team", "meet-team", "staff", "office", "headquarters",
    # French
    "nous-contacter", "au-sujet", "à-propos", "propos", "équipe", "qui-sommes-nous",
    "notre-équipe", "mentions-legales", "aide", "assistance", "bureau",
    # German
    "kontakt", "kontaktiere", "kontaktieren", "über-uns", "über", "ueber",
    "impressum", "unser-team", "wir", "firma", "unternehmen",
    "hilfe", "unterstützung", "büro",
    # Italian
    "contatti", "chi-siamo", "su-di-noi", "squadra", "ufficio",
    "informazioni", "aiuto", "supporto", "sede",
    # Portuguese
    "contato", "sobre", "sobre-nos", "equipe", "time", "quem-somos",
    "informacoes", "ajuda", "suporte", "escritorio",
    # Common
    "people", "directory", "location", "address", "phone", "email",
    "reach-us", "get-help", "customer-service", "atendimento", "servicio-cliente",
)


def shortest_words() -> list[str]:
    """The words left when every word that contains another one is dropped."""
    return [
        word
        for word in CONTACT_WORDS
        if not any(other in word for other in CONTACT_WORDS if other != word)
    ]
