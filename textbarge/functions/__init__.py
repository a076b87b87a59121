"""Column-expression building blocks (JVM-side, whole-stage-codegen friendly)."""

from .decode import (decode_bytes, has_nul_in_window, lenient_decode, lossy_utf8,  # noqa: F401
                     strict_decode, utf16_ok, utf32_ok)
from .errors import (null_error, lenient_error, make_error, strict_error, summary)  # noqa: F401
from .raster import pixels, raster_px, too_many_pixels  # noqa: F401
from .route import (extension, is_local, route, route_from_extension, route_from_type,  # noqa: F401
                    scheme, to_local_path, url_path)
from .text import (basename, is_blank, last_line_message, megabytes, megapixels,  # noqa: F401
                   notification, page_no, utrim)
