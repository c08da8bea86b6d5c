"""Unsupervised anomaly detection on time series, expressed as Spark plans."""

from tidewatch.functions.durations import parse_duration
from tidewatch.functions.window import AGGREGATIONS, Frame, aggregate, default_min_periods, double_rolling, rolling, window_bounds
from tidewatch.operators.calibration import Calibration, budget_threshold, tune_threshold
from tidewatch.operators.component import (
    BaseAggregator,
    BaseDetector,
    BaseScorer,
    BaseThreshold,
    BaseTransformer,
    Component,
    Configurable,
    NotFittedError,
)
from tidewatch.operators.detection import (
    AutoregressionDetector,
    EsdDetector,
    IqrDetector,
    LevelShiftDetector,
    MinClusterDetector,
    MultivariateScoreDetector,
    MultivariateSignedScoreDetector,
    OutlierDetector,
    PcaDetector,
    QuantileDetector,
    RegressionDetector,
    ScoreDetector,
    SeasonalDetector,
    SignedScoreDetector,
    SpikeDetector,
    ThresholdDetector,
    VolatilityShiftDetector,
)
from tidewatch.operators.ensemble import AndAggregator, CustomizedAggregator, OrAggregator, ScoreAggregator, VoteAggregator
from tidewatch.operators.evaluation import (
    average_precision,
    compare,
    detection_delay,
    detection_delays,
    f1_score,
    iou,
    precision,
    recall,
    roc_auc,
    split_train_test,
)
from tidewatch.operators.events import Events, expand_events, to_events, to_labels
from tidewatch.operators.features import (
    CustomizedTransformer,
    DoubleRollingAggregate,
    OrdinaryLeastSquares,
    PcaColumnError,
    PcaProjection,
    PcaReconstruction,
    PcaReconstructionError,
    RegressionResidual,
    Regressor,
    Retrospect,
    RollingAggregate,
    SeasonalDecomposition,
    StandardScale,
    SumAll,
)
from tidewatch.operators.methods import (
    DampDetector,
    DampScorer,
    HampelDetector,
    HampelScorer,
    MatrixProfileDetector,
    MatrixProfileScorer,
    MstlDetector,
    MstlResidualScorer,
    PeltDetector,
    PeltScorer,
    RollingQuantileDetector,
    RollingQuantileScorer,
    RupturesDetector,
    RupturesScorer,
    SpectralResidualDetector,
    SpectralResidualScorer,
    StlDetector,
    StlResidualScorer,
)
from tidewatch.operators.scoring import (
    AutoregressionResidualScorer,
    DeviationScorer,
    DoubleRollingScorer,
    MinClusterScorer,
    OutlierScorer,
    PcaReconstructionErrorScorer,
    RegressionResidualScorer,
    RollingAggregateScorer,
    SeasonalResidualScorer,
    TransformerScorer,
)
from tidewatch.operators.thresholds import EsdThreshold, FixedThreshold, IqrThreshold, MadThreshold, PotThreshold, QuantileThreshold
from tidewatch.plans.compose import Graph, Node, Pipeline
from tidewatch.plotting import plot
from tidewatch.sources.nab import load_nab, nab_names
from tidewatch.sources.series import Series, resampled, validate_series
from tidewatch.sources.synthetic import Dataset, make_series
from tidewatch.streaming.stream import Stream
from tidewatch.streaming.tails import online_pot

TimeSeries = Series

__all__ = [
    "AGGREGATIONS",
    "AndAggregator",
    "AutoregressionDetector",
    "AutoregressionResidualScorer",
    "BaseAggregator",
    "BaseDetector",
    "BaseScorer",
    "BaseThreshold",
    "BaseTransformer",
    "Calibration",
    "Component",
    "Configurable",
    "CustomizedAggregator",
    "CustomizedTransformer",
    "DampDetector",
    "DampScorer",
    "Dataset",
    "DeviationScorer",
    "DoubleRollingAggregate",
    "DoubleRollingScorer",
    "EsdDetector",
    "EsdThreshold",
    "Events",
    "FixedThreshold",
    "Frame",
    "Graph",
    "HampelDetector",
    "HampelScorer",
    "IqrDetector",
    "IqrThreshold",
    "LevelShiftDetector",
    "MadThreshold",
    "MatrixProfileDetector",
    "MatrixProfileScorer",
    "MinClusterDetector",
    "MinClusterScorer",
    "MstlDetector",
    "MstlResidualScorer",
    "MultivariateScoreDetector",
    "MultivariateSignedScoreDetector",
    "Node",
    "NotFittedError",
    "OrAggregator",
    "OrdinaryLeastSquares",
    "OutlierDetector",
    "OutlierScorer",
    "PcaColumnError",
    "PcaDetector",
    "PcaProjection",
    "PcaReconstruction",
    "PcaReconstructionError",
    "PcaReconstructionErrorScorer",
    "PeltDetector",
    "PeltScorer",
    "Pipeline",
    "PotThreshold",
    "QuantileDetector",
    "QuantileThreshold",
    "RegressionDetector",
    "RegressionResidual",
    "RegressionResidualScorer",
    "Regressor",
    "Retrospect",
    "RollingAggregate",
    "RollingAggregateScorer",
    "RollingQuantileDetector",
    "RollingQuantileScorer",
    "RupturesDetector",
    "RupturesScorer",
    "ScoreAggregator",
    "ScoreDetector",
    "SeasonalDecomposition",
    "SeasonalDetector",
    "SeasonalResidualScorer",
    "Series",
    "SignedScoreDetector",
    "SpectralResidualDetector",
    "SpectralResidualScorer",
    "SpikeDetector",
    "StandardScale",
    "StlDetector",
    "StlResidualScorer",
    "Stream",
    "SumAll",
    "ThresholdDetector",
    "TimeSeries",
    "TransformerScorer",
    "VolatilityShiftDetector",
    "VoteAggregator",
    "aggregate",
    "average_precision",
    "budget_threshold",
    "compare",
    "default_min_periods",
    "detection_delay",
    "detection_delays",
    "double_rolling",
    "expand_events",
    "f1_score",
    "iou",
    "load_nab",
    "make_series",
    "nab_names",
    "online_pot",
    "parse_duration",
    "plot",
    "precision",
    "recall",
    "resampled",
    "roc_auc",
    "rolling",
    "split_train_test",
    "to_events",
    "to_labels",
    "tune_threshold",
    "validate_series",
    "window_bounds",
]
