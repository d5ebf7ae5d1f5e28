"""Options of the operators, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class NormalizeOptions:
    """Steps of whitespace normalisation (all on by default)."""

    collapse_newlines: bool = True
    max_newlines: int = 2
    collapse_spaces: bool = True
    convert_tabs: bool = True
    spaces_per_tab: int = 1
    trim_line_end: bool = True
    trim_block: bool = True
    unicode_whitespace: bool = True


@dataclass(frozen=True)
class CleanerOptions:
    """Steps of the Markdown cleaner, and the page markers (fixed values)."""

    normalize_pagination: bool = True
    remove_artifacts: bool = True
    compact_blank_lines: bool = True
    extra_keywords: tuple[str, ...] = ()
    marker: str = "\n---\n\n**[Página {0}]**\n\n---\n"
    leading_marker: str = "**[Página {0}]**\n\n---\n"


@dataclass(frozen=True)
class ConversionOptions:
    """Options of document conversion."""

    extract_images: bool = False
    image_directory: str | None = None
    image_prefix: str = ""
    include_link_urls: bool = True
    include_page_markers: bool = False
    detect_headings: bool = True


@dataclass(frozen=True)
class HandwritingOptions:
    """Thresholds of the handwriting analysis (fixed values by default)."""

    min_score: float = 55.0
    max_side: int = 1600
    pdf_dpi: int = 150
    min_glyphs: int = 6
    min_regions: int = 1
    languages: str = "spa"
    detect_strokes: bool = True
    corroborate: bool = True
    printed_confidence: float = 78.0
    low_confidence: float = 55.0


@dataclass(frozen=True)
class OcrOptions:
    """Recognition of documents."""

    languages: str = "spa"
    prefer_embedded: bool = True
    min_embedded_chars: int = 16
    min_image_pixels: int = 40_000
    pdf_dpi: int = 300


@dataclass(frozen=True)
class LogoOptions:
    """A logo in the middle of a QR image: RGBA bytes, row by row, and their size."""

    pixels: bytes
    width: int
    height: int
    proportion: float = 0.22
    background: str | None = "#FFFFFF"
    margin: int = 8
    corner: float = 0.18


@dataclass(frozen=True)
class QrOptions:
    """Rendering of QR images."""

    correction: str | None = None
    pixels_per_module: int = 20
    size: int | None = None
    foreground: str = "#000000"
    background: str = "#FFFFFF"
    quiet_zone: bool = True
    logo: LogoOptions | None = None
