"""Small matrices, camera matrices and ego pose as column expressions.

A matrix is ``array<array<double>>``. The functions read their arguments
several times; bind an expensive argument to a column or a lambda first.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _at(matrix: Column, i: int, j: int) -> Column:
    return matrix[i][j]


def _rows(rows: list[list[Column]]) -> Column:
    return F.array(*[F.array(*row) for row in rows])


def multiply(a: Column, b: Column, n: int = 4) -> Column:
    """Matrix product ``a · b``, where ``b`` has ``n`` rows and columns."""

    def row_times_b(row: Column) -> Column:
        columns = []
        for j in range(n):
            total = row[0] * _at(b, 0, j)
            for k in range(1, n):
                total = total + row[k] * _at(b, k, j)
            columns.append(total)
        return F.array(*columns)

    return F.transform(a, row_times_b)


def inverse_rotation(r: Column) -> Column:
    """Inverse of a 3×3 matrix, orthogonal or not; a singular one is an error."""

    def minor(i: int, j: int) -> Column:
        # cyclic indices carry the sign of the cofactor
        a, b, c, d = (i + 1) % 3, (i + 2) % 3, (j + 1) % 3, (j + 2) % 3
        return _at(r, a, c) * _at(r, b, d) - _at(r, a, d) * _at(r, b, c)

    det = sum_of([_at(r, 0, j) * minor(0, j) for j in range(3)])
    adjugate = _rows([[minor(j, i) for j in range(3)] for i in range(3)])
    checked = F.when(det != 0, det).otherwise(F.raise_error(F.lit("singular rotation matrix")))
    scaled = F.transform(
        F.array(F.struct(adjugate.alias("adj"), checked.alias("det"))),
        lambda m: F.transform(m["adj"], lambda row: F.transform(row, lambda x: x / m["det"])),
    )
    return scaled[0]


def sum_of(terms: list[Column]) -> Column:
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def lidar_to_camera(inverse: Column, translation: Column) -> Column:
    """4×4 matrix from the lidar to the camera frame.

    ``inverse`` is the inverse of the camera-to-lidar rotation and
    ``translation`` the camera's position in the lidar frame.
    """
    rows = []
    for i in range(3):
        row = [_at(inverse, i, j) for j in range(3)]
        shift = sum_of([row[j] * translation[j] for j in range(3)])
        rows.append([*row, -shift])
    rows.append([F.lit(float(x)) for x in (0, 0, 0, 1)])
    return _rows(rows)


def pad_intrinsic(k: Column) -> Column:
    """An intrinsic matrix of at most 4×4 in the corner of the identity."""
    fits = (F.size(k) <= 4) & F.forall(k, lambda row: F.size(row) <= 4)

    def element(i: Column, j: Column) -> Column:
        identity = F.when(i == j, F.lit(1.0)).otherwise(F.lit(0.0))
        inside = (i < F.size(k)) & (j < F.size(k[0]))
        return F.when(inside, F.get(F.get(k, i), j)).otherwise(identity)

    side = F.sequence(F.lit(0), F.lit(3))
    padded = F.transform(side, lambda i: F.transform(side, lambda j: element(i, j)))
    return F.when(fits, padded).otherwise(F.raise_error(F.lit("intrinsic larger than 4x4")))


def lidar_to_image(padded_intrinsic: Column, lidar2cam: Column) -> Column:
    """4×4 projection of lidar points into the image."""
    return multiply(padded_intrinsic, lidar2cam)


def rescale_camera_matrix(lidar2img: Column, scale: float | Column) -> Column:
    """Projection into an image resized by ``scale``: rows 0 and 1 scaled."""
    s = F.lit(float(scale)) if isinstance(scale, (int, float)) else scale
    return F.transform(
        lidar2img,
        lambda row, i: F.when(i < 2, F.transform(row, lambda x: x * s)).otherwise(row),
    )


def quaternion_heading(rotation: Column) -> Column:
    """Yaw of a rotation (w, x, y, z) in degrees, in [0, 360).

    Both arguments of the arc tangent are quadratic in the quaternion, so
    its length does not matter.
    """
    w, x, y, z = (rotation[i] for i in range(4))
    yaw = F.degrees(F.atan2(2 * (w * z + x * y), w * w + x * x - y * y - z * z))
    return F.when(yaw < 0, yaw + 360).otherwise(yaw)


def write_pose_slots(can_bus: Column, translation: Column, rotation: Column, heading: Column) -> Column:
    """The vehicle-state vector with position, rotation and heading put in.

    Elements 0-2 take the translation, 3-6 the quaternion, and the last two
    the heading in radians and in degrees; the length stays.
    """
    n = F.size(can_bus)
    written = F.concat(
        F.slice(translation, 1, 3),
        F.slice(rotation, 1, 4),
        F.slice(can_bus, F.lit(8), F.greatest(n - 9, F.lit(0))),
        F.array(F.radians(heading), heading),
    )
    return F.when(n >= 9, written).otherwise(
        F.raise_error(F.lit("a vehicle-state vector needs at least 9 elements"))
    )
