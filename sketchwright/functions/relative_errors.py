"""Measured relative errors of the register and coupon summaries at small lg_k."""

from __future__ import annotations

import math

# HLL, lg_k 4 to 12, each for 1, 2 and 3 standard deviations. HIP: estimates that saw every key in order.
HLL_HIP_LOWER = (
    0.207316195, 0.502865572, 0.882303765, 0.146981579, 0.335426881, 0.557052, 0.104026721, 0.227683872, 0.365888317,
    0.073614601, 0.156781585, 0.245740374, 0.05205248, 0.108783763, 0.168030442, 0.036770852, 0.075727545, 0.11593785,
    0.025990219, 0.053145536, 0.080772263, 0.018373987, 0.037266176, 0.056271814, 0.012936253, 0.02613829, 0.039387631,
)
HLL_HIP_UPPER = (
    -0.207805347, -0.355574279, -0.475535095, -0.146988328, -0.262390832, -0.360864026, -0.103877775, -0.191503663, -0.269311582,
    -0.073452978, -0.138513438, -0.198487447, -0.051982806, -0.099703123, -0.144128618, -0.036768609, -0.07138158, -0.104430324,
    -0.025991325, -0.050854296, -0.0748143, -0.01834533, -0.036121138, -0.05327616, -0.012920332, -0.025572893, -0.037896952,
)
HLL_LOWER = (
    0.254409839, 0.682266712, 1.304022158, 0.181817353, 0.443389054, 0.778776219, 0.129432281, 0.295782195, 0.49252279,
    0.091640655, 0.201175925, 0.323664385, 0.064858051, 0.138523393, 0.218805328, 0.045851855, 0.095925072, 0.148635751,
    0.032454144, 0.067009668, 0.102660669, 0.022921382, 0.046868565, 0.071307398, 0.016155679, 0.032825719, 0.049677541,
)
HLL_UPPER = (
    -0.256980172, -0.411905944, -0.52651057, -0.182332109, -0.310275547, -0.412660505, -0.129314228, -0.230142294, -0.315636197,
    -0.091584836, -0.16834013, -0.236346847, -0.06487411, -0.122045231, -0.174112107, -0.04591465, -0.08784505, -0.126917615,
    -0.032433119, -0.062897613, -0.091862929, -0.022960633, -0.044875401, -0.065736049, -0.016186662, -0.031827816, -0.046973459,
)

# CPC, lg_k 4 to 14, each for 1, 2 and 3 standard deviations, in ten-thousandths of 1 / sqrt(k).
CPC_UPPER = (
    6037, 5720, 5328, 6411, 6262, 5682, 6724, 6403, 6127, 6665, 6411, 6208, 6959, 6525, 6427, 6892, 6665, 6619,
    6792, 6752, 6690, 6899, 6818, 6708, 6871, 6845, 6812, 6909, 6861, 6828, 6919, 6897, 6842,
)
CPC_LOWER = (
    8031, 8559, 9309, 7084, 7959, 8660, 7141, 7514, 7876, 7458, 7430, 7572, 6892, 7141, 7497, 6889, 7132, 7290,
    7075, 7118, 7185, 7040, 7047, 7085, 6993, 7019, 7053, 6953, 7001, 6983, 6944, 6966, 7004,
)
CPC_HIP_UPPER = (
    5871, 5247, 4826, 5877, 5403, 5070, 5873, 5533, 5304, 5878, 5632, 5464, 5874, 5690, 5564, 5880, 5745, 5619,
    5875, 5784, 5701, 5866, 5789, 5742, 5869, 5827, 5784, 5876, 5860, 5827, 5881, 5853, 5842,
)
CPC_HIP_LOWER = (
    5855, 6688, 7391, 5886, 6444, 6923, 5885, 6254, 6594, 5889, 6134, 6326, 5900, 6072, 6203, 5875, 6005, 6089,
    5871, 5980, 6040, 5889, 5941, 6015, 5871, 5926, 5973, 5866, 5901, 5915, 5880, 5914, 5953,
)

HLL_HIP_FACTOR, HLL_FACTOR = 0.8325546, 1.03896
CPC_FACTOR, CPC_HIP_FACTOR = math.log(2), math.sqrt(math.log(2) / 2)


def cpc_error(lg_k: int, deviations: int, upper: bool, hip: bool = False) -> float:
    """The relative error of a CPC estimate at so many deviations."""
    table = (CPC_HIP_UPPER if upper else CPC_HIP_LOWER) if hip else (CPC_UPPER if upper else CPC_LOWER)
    x = table[3 * (lg_k - 4) + deviations - 1] / 10000 if lg_k <= 14 else CPC_HIP_FACTOR if hip else CPC_FACTOR
    return deviations * x / math.sqrt(1 << lg_k)


def hll_error(lg_k: int, deviations: int, upper: bool, hip: bool = False) -> float:
    """The signed relative error of an HLL estimate at so many deviations; the bound is estimate / (1 + error)."""
    if lg_k > 12:
        return (-1 if upper else 1) * deviations * (HLL_HIP_FACTOR if hip else HLL_FACTOR) / math.sqrt(1 << lg_k)
    table = (HLL_HIP_UPPER if upper else HLL_HIP_LOWER) if hip else (HLL_UPPER if upper else HLL_LOWER)
    return table[3 * (lg_k - 4) + deviations - 1]
