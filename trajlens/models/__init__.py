"""Models that rebuild a window, and their storage."""

from trajlens.models.reconstruct import (
    DenseAutoencoder,
    MeanProfile,
    PcaLocal,
    PcaWindow,
    Reconstructor,
    load,
    loss,
    save,
)

__all__ = ["DenseAutoencoder", "MeanProfile", "PcaLocal", "PcaWindow", "Reconstructor", "load", "loss", "save"]
